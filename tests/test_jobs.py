"""Registered jobs without SQL: what they are run over."""

import os

import pytest

from tidemark.operators import walkforward
from tidemark.operators.features import MODEL_FEATURES
from tidemark.plans import jobs
from tidemark.plans.queries import WINDOWS

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_walk_forward_is_registered_whole(spark, monkeypatch):
    given = []
    monkeypatch.setattr(walkforward, "walk_forward", lambda features, market, windows, settings, sentiment, alerts: given.append((windows, settings, sentiment, alerts)) or (None, None))
    jobs.walk(spark, DATA)
    (windows, s, sentiment, alerts), = given
    assert list(windows) == list(WINDOWS)
    assert (list(s.features), s.trees, s.folds, s.forest) == (list(MODEL_FEATURES), 300, 5, 100)
    assert s.boost and s.defensives and s.meta == "logistic" and alerts.count() and sentiment.filter("sentiment_raw is not null").count()


def test_hidden_states_of_every_window(spark):
    got = {r["iteration"] for r in jobs.hidden_states(spark, DATA).select("iteration").distinct().collect()}
    assert got == {w[0] for w in WINDOWS}


def test_market_features_have_the_equity_correlation(spark):
    assert "avg_correlation" in walkforward.REGIME and len(walkforward.REGIME) == 7
    rows = jobs.regime_rows(spark, DATA)
    assert set(walkforward.REGIME) <= set(rows.columns)
    assert rows.filter("avg_correlation between -1 and 1").count() > 20
