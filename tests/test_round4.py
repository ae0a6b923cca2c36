"""What large tables asked for: little written for each window, and the same results."""

from __future__ import annotations

import datetime as dt
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import boosting, models, quality

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
WINDOWS = [(1, DAYS[0], DAYS[19], DAYS[20], DAYS[29]), (2, DAYS[0], DAYS[29], DAYS[30], DAYS[44]), (3, DAYS[5], DAYS[24], DAYS[15], DAYS[40])]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(s, d, float(rng.integers(0, 2)), float(rng.normal())) for s in ("a", "b", "c", None) for d in DAYS if rng.random() < 0.7]
    return spark.createDataFrame([*made, ("a", None, 1.0, 0.5)], "symbol string, date date, y double, x double")


@pytest.mark.parametrize("embargo", [True, False])
def test_rows_reach_their_windows_without_an_exchange(spark, rows, embargo):
    spans = quality.windows_frame(spark, WINDOWS)
    stored = quality.with_next(rows).localCheckpoint()
    got = quality.assign_windows(stored, spans, embargo)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    within = lambda a, b: F.col("date").between(F.col(a), F.col(b))
    want = rows.join(spans, within("train_start", "train_end") | within("val_start", "val_end")).withColumn("split", F.when(within("train_start", "train_end"), "train").otherwise("val"))
    last = F.row_number().over(Window.partitionBy("iteration", "symbol", "split").orderBy(F.desc("date"))) == 1
    want = want.withColumn("last", last).filter(~((F.col("split") == "train") & F.col("last") & (F.lit(embargo is True) | (F.col("date") >= F.col("val_start")))))
    key = lambda df: sorted(map(str, df.select("symbol", "date", "y", "x", "iteration", "split").collect()))
    assert key(got) == key(quality.assign_windows(rows, spans, embargo)) == key(want) and len(key(want)) > 200


def test_folds_by_counts_equal_places_in_order(spark, rows):
    df = rows.withColumn("g", F.when(F.col("x") > 0, 1).otherwise(2))
    got = models.with_folds(df, "y", 4, ["date", "symbol"], "g").collect()
    want = {}
    for g in (1, 2):
        for y in (0.0, 1.0):
            own = sorted((r for r in df.collect() if (r["g"], r["y"]) == (g, y)), key=lambda r: (r["date"] is not None, r["date"] or 0, r["symbol"] is not None, r["symbol"] or ""))
            want |= {(r["symbol"], r["date"], r["x"]): min(i * 4 // len(own), 3) for i, r in enumerate(own)}
    assert {(r["symbol"], r["date"], r["x"]): r["fold"] for r in got} == want and len(got) == df.count()


def test_boosting_keeps_one_state_of_its_margins(spark, tmp_path, monkeypatch):
    """Blocks of a spread group were written anew every few trees, and all of them stayed."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(0, i % 2, i, float(rng.integers(0, 2)), float(rng.normal())) for i in range(200)], "g int, fold int, k int, y double, a double")
    monkeypatch.setattr(boosting, "work_dir", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    spread = boosting._fit_spread
    kept = []
    monkeypatch.setattr(boosting, "_fit_spread", lambda *a: spread(*a, refresh=2))
    monkeypatch.setattr(boosting, "discard", lambda spark, path, own=boosting.discard: (kept.append(len([p for p in os.listdir(tmp_path) if p.startswith("boosting-blocks")])), own(spark, path)))
    far, near = (boosting.fit(df, ["a"], "y", "g", "fold", ["k"], boosting.Boosting(trees=7, depth=2, bins=16), gathered=n) for n in (0, 10**6))
    assert max(kept) <= 2 and len(kept) == 4 and not [p for p in os.listdir(tmp_path) if p.startswith("boosting-blocks")]
    assert all((far.models[k].value == near.models[k].value).all() for k in near.models)
