"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df, ref = entry.queries()[name](spark, DATA), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert sorted(ref.columns) == cols
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    at = [ref.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in ref.fetchall()), key=key)
    assert len(got) == len(want)
    assert not [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))][:3]


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
