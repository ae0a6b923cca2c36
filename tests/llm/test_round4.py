"""Faults found on larger tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import language_model as L
from tidemark.llm import pii


def test_terms_joined_to_a_value_and_known_from_values_only(spark):
    """`def` is left of document 0 when its address goes, but stands only inside an e-mail address elsewhere: counted in no document, it was divided by."""
    rows = [(0, "a 10.0.0.1def y"), (1, "hello def@foo.com z"), (2, "b 10.0.0.7 Qwx"), *[(i, f"plain words number {i}") for i in range(3, 40)]]
    got = {r["doc_id"]: r.asDict() for r in pii.digest(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    with duckdb.connect() as con:
        con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
        found = con.sql(pii.OP3_SQL)
        want = {r[0]: dict(zip(found.columns, r, strict=True)) for r in found.fetchall()}
    assert got == want and got[0]["spans"] == "ip:2:10" and got[1]["spans"] == "email:6:17"


def test_classes_hold_every_id_and_their_shares_are_whole():
    """A class for every id, seen or not, and shares that add up to 1; so do ids after any class."""
    rng = np.random.default_rng(5)
    for counts in (rng.zipf(1.3, 5000).clip(0, 10**7).astype(float) * (rng.random(5000) < 0.7), np.zeros(300), np.ones(7)):
        classes, inside = L.grouped(counts)
        assert len(classes) == len(inside) == len(counts) and classes.min() >= 0 and classes.max() < L.CLASSES and np.isfinite(inside).all()
        assert np.bincount(classes, np.exp(inside), L.CLASSES)[np.unique(classes)] == pytest.approx(1)
        pairs = rng.integers(0, 9, (L.CLASSES, L.CLASSES)).astype(float)
        assert np.exp(L.neighbours(pairs)).sum(1) == pytest.approx(1, rel=1e-5)
