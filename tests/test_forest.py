"""Isolation trees against path lengths walked one row at a time; queries that read the lines once or twice."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry
from tidemark.operators import models

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def path(tree, row, depth=0):
    if not isinstance(tree, list):
        return depth + tree
    return path(tree[2] if row[tree[0]] < tree[1] else tree[3], row, depth + 1)


def test_scores_equal_paths_walked_by_hand(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(150, 3)), [[9, 9, 9], [0, 0, 0]]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    forest = models.IsolationForest(["a", "b", "c"], trees=12, psi=64).fit(df)
    assert len(forest.forest) == 12 and forest.norm == pytest.approx(2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64)
    want = {tuple(r): -(2.0 ** (-np.mean([path(t, r) for t in forest.forest]) / forest.norm)) for r in x.tolist()}
    got = {(r["a"], r["b"], r["c"]): r["score"] for r in forest.predict(df).collect()}
    assert got == pytest.approx(want) and min(got, key=got.get) == (9, 9, 9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", ["buy_and_hold", "agent_alignment", "regime_table", "mark_to_market", "normalize_by_class"])
def test_lines_are_read_once_or_twice(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") == 0 or plan.count("Relation [l_orderkey") <= 1
