"""Queries of training-data operators against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.llm.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df, ref = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(ref.columns) == cols
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    at = [ref.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in ref.fetchall()), key=key)
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9)
    assert len(got) == len(want) and not [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))][:3]
