"""Percentiles by counting, pages by cursor, spans of alerts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, asof, reports
from tidemark.operators.quantiles import percentiles

DAYS = [dt.date(2021, 1, 4) + dt.timedelta(days=i) for i in range(120)]


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_percentiles_equal_sorting(spark, bins):
    rng = np.random.default_rng(1)
    groups = {1: rng.normal(size=300), 2: rng.integers(0, 3, 200).astype(float), 3: np.array([5.0]), 4: np.array([-1e308, 0.0, 1e308, 5e-324]), 5: np.array([])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(5, None), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    wanted = [0, 2.5, 5, 50, 99.9, 100]
    got = {(r["g"], r["percentile"]): r["threshold"] for r in percentiles(df, "v", wanted, "g", bins).collect()}
    want = {(r["g"], p): r["t"][i] if r["t"] else None for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in wanted])).alias("t")).collect() for i, p in enumerate(wanted)}
    assert set(got) == {(g, float(p)) for g in groups for p in wanted}
    for k, v in got.items():
        assert v == (None if want[k] is None else pytest.approx(want[k], rel=1e-12)), k
    assert percentiles(df.limit(0), "v", [50]).collect()[0]["threshold"] is None


def test_pages_by_cursor(spark):
    rng = np.random.default_rng(2)
    rows = [(DAYS[int(d)], i, None if i % 7 == 0 else f"s{i % 5}") for i, d in enumerate(rng.integers(0, 9, 103))]
    df = spark.createDataFrame(rows, "date date, trade_id int, symbol string")
    logs = [df.filter("trade_id % 2 = 0"), df.filter("trade_id % 2 = 1")]
    seen, cursor = [], None
    while True:
        page, total = reports.trades_after(logs, 10, cursor)
        found = page.collect()
        assert total.first()["total"] == 103
        if not found:
            break
        seen += found
        cursor = found[-1].asDict()
    whole = reports.page_trades(logs, 1000)[0].collect()
    assert seen == whole and len(seen) == 103
    by_symbol = [x.select("date", "symbol", "trade_id") for x in logs]  # nulls among the keys
    assert reports.trades_after(by_symbol, 7, reports.page_trades(by_symbol, 1, 40)[0].first().asDict())[0].collect() == reports.page_trades(by_symbol, 7, 41)[0].collect()


def test_alert_spans_hold_the_days_of_each_signal(spark):
    rng = np.random.default_rng(3)
    sessions = [d for d in DAYS if d.weekday() < 5]
    signals = {(s, sessions[int(i)]) for s in "abc" for i in rng.integers(0, len(sessions), 6)}
    df = spark.createDataFrame(sorted(signals), "symbol string, signal_date date")
    spans = alerts.alert_spans(df, 10).collect()
    days = [(r["symbol"], r["from"] + dt.timedelta(days=k)) for r in spans for k in range((r["to"] - r["from"]).days + 1)]
    assert len(days) == len(set(days)) and set(days) == {(s, d + dt.timedelta(days=k)) for s, d in signals for k in range(11)}
    cal = asof.numbered_calendar(spark.createDataFrame([(d,) for d in sessions], "date date"))
    tx = spark.createDataFrame([(s, d, "S", "CEO", 0.5) for s, d in sorted(signals)], "symbol string, filing_date date, transaction_type string, role string, shares_sold_pct double")
    got = {tuple(r) for r in alerts.insider_alerts(tx, cal, lookback=10, lag=0).collect()}
    assert got == {(s, d) for s, d in days if d in set(sessions)}
