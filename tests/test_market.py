import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import asof, features, ledger, metrics, models, quality, regime, reports, sizing
from tidemark.sources import filings, io
from tidemark.streaming import daily

DAYS = [d.date() for d in pd.bdate_range("2021-01-04", periods=100)]


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(3)
    rows = []
    for s in ("A", "B"):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.01, 100))
        rows += [(s, d, c * 0.99, c * 1.01, c * 0.98, c, float(v)) for d, c, v in zip(DAYS, close, rng.integers(1_000_000, 5_000_000, 100), strict=True)]
    return pd.DataFrame(rows, columns=["symbol", "date", "open", "high", "low", "close", "volume"])


def bars(spark, pdf):
    return spark.createDataFrame(pdf, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_features_equal_pandas(spark, prices):
    got = features.compute_all_features(bars(spark, prices)).filter("symbol = 'A'").orderBy("date").toPandas()
    c = prices[prices.symbol == "A"].set_index("date")["close"]
    change = c.diff()
    gain, loss = (x.ewm(com=13, min_periods=14).mean() for x in (change.clip(lower=0).where(change.notna()), (-change).clip(lower=0).where(change.notna())))
    want = {
        "return_5d": c.pct_change(5),
        "close_norm": c / c.rolling(20).mean(),
        "rsi_14": 100 - 100 / (1 + gain / loss),
        "macd": c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean(),
        "bb_bandwidth": 4 * c.rolling(20).std() / c.rolling(20).mean(),
        "target_return_1d": c.shift(-1) / c - 1,
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name].astype(float), series.to_numpy(), rtol=1e-9, atol=1e-12, equal_nan=True)


def test_rolled_windows_equal_pandas_and_take_lags(spark, prices):
    """Means and deviations by lags instead of frames: with gaps, a symbol that stands still, and windows without small factors."""
    gaps = prices.assign(close=prices["close"].where(np.arange(len(prices)) % 31 != 7))
    still = prices[prices.symbol == "A"].assign(symbol="S", close=100.1)
    rows = bars(spark, pd.concat([gaps, still]).astype({"close": object}).where(lambda x: x.notna(), None))
    got = features.rolled(rows, [("close", 20), ("close", 50), ("close", 23), ("close", 1)], [("close", 20), ("close", 13)])
    assert "-19, currentrow" not in features.rolled(rows, [("close", 20)], [("close", 20)])._jdf.queryExecution().optimizedPlan().toString().replace("$()", "")
    got = got.orderBy("symbol", "date").toPandas()
    for _, g in got.groupby("symbol"):
        c = g["close"].astype(float)
        for n in (20, 50, 23, 1):
            np.testing.assert_allclose(g[features.mean_of("close", n)].astype(float), c.rolling(n).mean(), rtol=1e-12)
        for n in (20, 13):
            np.testing.assert_allclose(g[features.dev_of("close", n)].astype(float), c.rolling(n).std(), rtol=1e-9, atol=1e-9)
    s = got[got.symbol == "S"][features.dev_of("close", 20)].dropna()
    assert len(s) == 81 and (s == 0.0).all()


def test_features_bring_rows_together_once(spark, prices):
    """One exchange by symbol, nothing by ranges; batches of a few rows give the same."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = features.compute_all_features(bars(spark, prices))
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        got = df.orderBy("symbol", "date").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pd.testing.assert_frame_equal(got, features.compute_all_features(bars(spark, prices)).orderBy("symbol", "date").toPandas(), rtol=1e-12)


def test_rsi_without_losses_is_null(spark):
    pdf = pd.DataFrame({"symbol": "A", "date": DAYS[:40], "open": 1.0, "high": 1.0, "low": 1.0, "close": np.arange(1.0, 41.0), "volume": 1.0})
    assert features.compute_all_features(bars(spark, pdf)).filter("rsi_14 is not null").count() == 0


@pytest.mark.parametrize("build", [lambda b: features.compute_all_features(b).drop("target_return_1d", "target_binary"), lambda b: regime.build_regime_features(b, b.filter("symbol = 'A'").select("date", "close"))])
def test_later_prices_do_not_move_earlier_features(spark, prices, build):
    shocked = prices.copy()
    shocked.loc[shocked.date >= DAYS[80], ["open", "high", "low", "close"]] *= 3
    early = F.col("date") < F.lit(DAYS[80])
    a, b = (build(bars(spark, p)).filter(early) for p in (prices, shocked))
    order = [c for c in ("symbol", "date") if c in a.columns]
    pd.testing.assert_frame_equal(a.orderBy(order).toPandas(), b.orderBy(order).toPandas())


def test_correlation_forms_agree(spark, prices):
    rng = np.random.default_rng(5)
    pdf = pd.concat([prices[prices.symbol == "A"].assign(symbol=s, close=100 * np.cumprod(1 + rng.normal(0, 0.01, 100))) for s in "WXYZ"])
    rets = regime.daily_returns(bars(spark, pdf))
    a = regime.rolling_avg_correlation(rets).join(regime.complete_avg_correlation(rets).withColumnRenamed("avg_correlation", "fast"), "date").filter("fast is not null").toPandas()
    assert len(a) > 70
    np.testing.assert_allclose(a["avg_correlation"], a["fast"], atol=1e-9)


@pytest.mark.parametrize("block", [128, 4])
def test_correlation_in_blocks_equals_pair_by_pair(spark, block):
    """With gaps, ties and still symbols, whether the symbols lie in one block or in several."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (90, 11)) + rng.normal(0, 1, (90, 1))
    x[:, 3] = 0.5  # stands still
    x[40:, 4] = 0.0
    gone = rng.random(x.shape) < 0.35
    rows = [(f"s{k}", DAYS[t], None if t % 17 == 5 else float(x[t, k])) for t in range(90) for k in range(11) if not gone[t, k]]
    got = {r["date"]: r["avg_correlation"] for r in regime.rolling_avg_correlation(spark.createDataFrame(rows, "symbol string, date date, ret double"), symbol_block=block).collect()}
    series = {}
    for s, d, r in rows:
        if r is not None:
            series.setdefault(s, {})[d] = r
    want = {}
    for a in series:
        for b in series:
            if a < b:
                common = sorted(set(series[a]) & set(series[b]))
                for t, d in enumerate(common):
                    p, q = (np.array([series[s][c] for c in common[max(0, t - 19) : t + 1]]) for s in (a, b))
                    want.setdefault(d, [])
                    if len(p) >= 10 and np.ptp(p) > 0 and np.ptp(q) > 0:
                        want[d].append(np.corrcoef(p, q)[0, 1])
    assert set(got) == set(want) and any(v is None for v in got.values())
    for d, v in want.items():
        assert got[d] == (pytest.approx(np.mean(v), abs=1e-12) if v else None)
    plan = regime.rolling_avg_correlation(spark.createDataFrame(rows, "symbol string, date date, ret double"))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_correlation_takes_symbols_as_arrays(spark):
    """A symbol is a row of arrays when it is copied to other blocks; windows that hardly move are worked around their means."""
    rng = np.random.default_rng(4)
    x = 1000 + 1e-7 * rng.normal(0, 1, (40, 3))
    rets = spark.createDataFrame([(f"s{k}", DAYS[t], float(x[t, k])) for t in range(40) for k in range(3)], "symbol string, date date, ret double")
    found = regime.rolling_avg_correlation(rets, symbol_block=2)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {r["date"]: r["avg_correlation"] for r in found.collect()}
    for t in range(9, 40):
        c = np.corrcoef((x[max(0, t - 19) : t + 1] - 1000).T)
        assert got[DAYS[t]] == pytest.approx((c[0, 1] + c[0, 2] + c[1, 2]) / 3, abs=1e-6)


def test_breadth_and_single_symbol(spark):
    rows = [("A", DAYS[0], 0.1), ("B", DAYS[0], 0.2), ("A", DAYS[1], -0.1), ("B", DAYS[1], -0.2), ("A", DAYS[2], 0.1), ("B", DAYS[2], -0.1), ("A", DAYS[3], None)]
    got = regime.market_breadth(spark.createDataFrame(rows, "symbol string, date date, ret double")).orderBy("date").collect()
    assert [r["market_breadth"] for r in got] == [1.0, 0.0, 0.5, None]


def test_asof_keeps_left_rows(spark):
    left = spark.createDataFrame([(d,) for d in DAYS[:12]], "date date")
    right = spark.createDataFrame([(DAYS[1], 20.0), (DAYS[10], 25.0)], "date date, close double")
    assert [r["v"] for r in asof.asof_backward(left, right, [], "date", "close", "v").orderBy("date").collect()] == [None] + [20.0] * 9 + [25.0] * 2


@pytest.mark.parametrize("bucket", [1, 7, 64])
def test_asof_over_buckets_equals_pandas(spark, bucket):
    rng = np.random.default_rng(3)
    day = lambda k: DAYS[0] + dt.timedelta(days=int(k))
    left = [(k, day(t), i) for i, (k, t) in enumerate(zip(rng.choice(["a", "b", "c"], 300), rng.integers(0, 400, 300), strict=True))] + [("a", None, 999), (None, day(5), 998)]
    right = [(k, day(t), None if t % 5 == 0 else float(t)) for k in "ab" for t in np.unique(rng.integers(100, 400, 40))] + [("z", day(1), 1.0)]
    a, b = spark.createDataFrame(left, "k string, d date, i int"), spark.createDataFrame(right, "k string, d date, v double")
    got = asof.asof_backward(a, b, ["k"], "d", "v", bucket=bucket)
    rows = {r["i"]: r["v"] for r in got.collect()}
    for k, d, i in left:
        past = [(e, v) for key, e, v in right if key == k and d is not None and e <= d and v is not None]
        assert rows[i] == (max(past)[1] if past else None)
    lone = asof.asof_backward(a.select("d", "i"), b.filter("k = 'a'").select("d", "v"), [], "d", "v", bucket=bucket)
    rows = {r["i"]: r["v"] for r in lone.collect()}
    for _, d, i in left:
        past = [(e, v) for key, e, v in right if key == "a" and d is not None and e <= d and v is not None]
        assert rows[i] == (max(past)[1] if past else None)
    windows = [line for line in lone._jdf.queryExecution().toString().split("\n") if "windowspecdefinition" in line]
    assert windows and all("windowspecdefinition(_bucket" in line for line in windows)


def test_sessions_after_close_weekend_and_end(spark):
    cal = asof.numbered_calendar(spark.createDataFrame([(d,) for d in DAYS[:6]], "date date"))
    news = spark.createDataFrame([("2021-01-04 20:59:00",), ("2021-01-04 21:00:00",), ("2021-01-09 12:00:00",), ("2021-01-12 12:00:00",)], "t string").withColumn("created_at", F.to_timestamp("t"))
    got = [r["session_date"] for r in asof.assign_to_sessions(news, cal).orderBy("t").collect()]
    assert got == [dt.date(2021, 1, 4), dt.date(2021, 1, 5), dt.date(2021, 1, 11), None]


def test_kelly_values_and_caps(spark):
    rows = spark.createDataFrame([(0.6, 1.0, "equity"), (0.3, 1.0, "equity"), (0.95, 10.0, "equity"), (0.95, 10.0, "bond"), (0.6, 0.0, "equity"), (0.6, -1.0, "equity")], "p double, b double, c string")
    got = [r[0] for r in rows.select(sizing.kelly_size(F.col("p"), F.col("b"), F.col("c"), F.lit(0.5))).collect()]
    assert got == pytest.approx([0.1, 0.0, 0.15, 0.20, 0.0, 0.0])


def test_class_caps(spark):
    rows = [("r", DAYS[0], f"b{i}", "bond", 0.2) for i in range(2)] + [("s", DAYS[0], f"e{i}", "equity", 0.1) for i in range(8)]
    got = sizing.normalize_by_class(spark.createDataFrame(rows, "run_id string, date date, symbol string, asset_class string, f double"), ["run_id", "date"]).groupBy("run_id").agg(F.sum("f").alias("f"))
    assert {r["run_id"]: round(r["f"], 9) for r in got.collect()} == {"r": 0.3, "s": 0.8}


def signals(spark, signal, f, price=None, atr=None):
    n = len(signal)
    rows = [("r", "A", 0, DAYS[i], price[i] if price else 100.0, signal[i], f[i], 0, atr) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, symbol string, symbol_rank int, date date, price double, signal double, f_star double, veto int, atr double")


def actions(df):
    return [(r["action"], r["reason"], r["date"]) for r in df.filter("kind = 'trade'").orderBy("date").collect()]


def test_hysteresis_sells_on_the_third_weak_day(spark):
    df = ledger.portfolio_replay(signals(spark, [0.6, 0.4, 0.4, 0.4, 0.4], [0.1, 0.05, 0.05, 0.05, 0.0]), ledger.ReplayRules(sell_below=0.45, hysteresis=3))
    assert [(a, d) for a, _, d in actions(df)][:2] == [("BUY", DAYS[0]), ("SELL", DAYS[3])]


def test_entry_filter_stop_and_close(spark):
    assert actions(ledger.portfolio_replay(signals(spark, [0.52], [0.1]), ledger.ReplayRules(min_prob=0.55))) == []
    stopped = ledger.portfolio_replay(signals(spark, [0.6] * 3, [0.1, 0.0, 0.0], [100.0, 90.0, 90.0], 2.0), ledger.ReplayRules(hysteresis=9))
    assert [x[:2] for x in actions(stopped)] == [("BUY", "signal"), ("SELL", "stop_loss")]
    closed = ledger.portfolio_replay(signals(spark, [0.6] * 2, [0.1] * 2), ledger.ReplayRules(close_at_end=True))
    stats = ledger.close_stats(closed).first()
    assert stats["n_positions_closed"] == 1 and stats["capital_after_close"] == pytest.approx(10_000 - 1000 * 0.0008 - 999.2 * 0.0008, abs=0.01)


def test_replay_holds_a_day_at_a_time(spark):
    """Runs stream through tasks; days that lie in several batches give the same as whole ones."""
    rng = np.random.default_rng(6)
    rows = [(f"r{r}", f"s{k}", k, DAYS[t], float(100 + rng.normal(0, 9)), float(rng.random()), float(max(0.0, rng.normal(0.02, 0.05))), 0, 3.0) for r in range(3) for t in range(30) for k in range(9)]
    df = spark.createDataFrame(rows, "run_id string, symbol string, symbol_rank int, date date, price double, signal double, f_star double, veto int, atr double")
    found = []
    for size in (4, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = ledger.portfolio_replay(df, ledger.ReplayRules(hysteresis=2, close_at_end=True))
        found.append(sorted(map(str, out.collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and sum("equity=None" not in x for x in found[0]) == 90
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_forms_without_a_sale_are_not_parsed(spark):
    form = "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>{}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>30</value></sharesOwnedFollowingTransaction></postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    rows = [(code, DAYS[0], form.format(code)) for code in ("S", " S- ", "&#83;", "<![CDATA[S]]>", "P", "A")]
    found = filings.parse_form4(spark.createDataFrame(rows, "symbol string, filing_date date, xml string"))
    assert sorted(r["symbol"] for r in found.collect()) == sorted(["S", " S- ", "&#83;", "<![CDATA[S]]>"])
    assert "RLIKE" in found._jdf.queryExecution().optimizedPlan().toString()


def test_rebalance_interval(spark):
    df = ledger.portfolio_replay(signals(spark, [0.4, 0.6, 0.6, 0.6, 0.6, 0.6], [0.0, 0.1, 0.1, 0.1, 0.1, 0.1]), ledger.ReplayRules(rebalance_every=3))
    assert [(a, d) for a, _, d in actions(df)] == [("BUY", DAYS[3])]


def test_sma_closed_form_equals_a_loop(spark, prices):
    got = ledger.sma_sleeves(bars(spark, prices), 5, 10, 100.0).filter("symbol = 'A'").orderBy("date").toPandas()["equity"]
    c = prices[prices.symbol == "A"]["close"].reset_index(drop=True)
    on = (c.rolling(5).mean() > c.rolling(10).mean()).to_numpy()
    value, held, want = 100.0, False, []
    for i in range(len(c)):
        if held:
            value *= c[i] / c[i - 1]
        if on[i] != held:
            value, held = value * (1 - 0.0008), on[i]
        want.append(value)
    np.testing.assert_allclose(got, want, rtol=1e-10)


def test_metrics_edges(spark):
    rows = [("down", DAYS[i], e) for i, e in enumerate([10000.0, 9000.0, 8000.0, 8500.0])] + [("flat", DAYS[i], 1.0) for i in range(3)] + [("gap", DAYS[0], 1.0), ("gap", DAYS[1], None), ("gap", DAYS[2], 1.1)]
    got = {r["run_id"]: r for r in metrics.summary(spark.createDataFrame(rows, "run_id string, date date, equity double")).collect()}
    assert got["down"]["max_drawdown_pct"] == -20.0 and got["down"]["total_return_pct"] == -15.0
    assert (got["flat"]["sharpe"], got["flat"]["calmar"]) == (0.0, 0.0)
    assert got["gap"]["total_return_pct"] == 10.0 and got["gap"]["n_days"] == 2


def test_windows(spark):
    w = quality.generate_windows(dt.date(2018, 1, 1), dt.date(2025, 1, 1))
    assert [x[3].year for x in w] == [2021, 2022, 2023, 2024] and w[-1][4] == dt.date(2024, 12, 31)
    assert quality.holdout_window(dt.date(2018, 1, 1), dt.date(2025, 1, 1), dt.date(2025, 12, 31), 5)[0] == 5


FORM = """<ownershipDocument{ns}><reportingOwner><reportingOwnerRelationship><isDirector>{director}</isDirector>{title}</reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction>
<transactionDate><value>{date}</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}</value></transactionShares>
<transactionAcquiredDisposedCode><value>{ad}</value></transactionAcquiredDisposedCode></transactionAmounts><postTransactionAmounts><sharesOwnedFollowingTransaction><value>{left}</value></sharesOwnedFollowingTransaction></postTransactionAmounts>
</nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""


def test_form4(spark):
    base = {"ns": "", "director": 0, "title": "<officerTitle>Chief Executive Officer</officerTitle>", "date": "2021-01-05", "code": "S", "n": "10,000", "ad": "D", "left": 30000}
    docs = [base, base | {"director": 1, "title": "", "n": 500, "left": 9000}, base | {"code": "P", "ad": "A"}, base | {"ns": ' xmlns="urn:x"', "title": "<officerTitle>President</officerTitle>", "date": "bad"}, base | {"n": "many"}]
    rows = [(str(i), dt.date(2021, 1, 7), FORM.format(**x)) for i, x in enumerate(docs)] + [("bad", dt.date(2021, 1, 7), "<a><b>"), ("null", dt.date(2021, 1, 7), None)]
    got = {r["symbol"]: (r["role"], r["shares_sold_pct"], r["trade_date"].day) for r in filings.parse_form4(spark.createDataFrame(rows, "symbol string, filing_date date, xml string")).collect()}
    assert got == {"0": ("CEO", 0.25, 5), "1": ("Director", 0.052632, 5), "3": ("President", 0.25, 7)}


def test_roles(spark):
    titles = {"CEO": "CEO", "Chief Financial Officer": "CFO", "COO and Director": "COO", "Director": "Director", "VP of Marketing": "VP of Marketing", "President": "President", "C.E.O.": "CEO", "Interim c.f.o": "CFO", "C.O.O.": "COO", "C.T.O.": "CTO", "Chief Technical Officer": "CTO"}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", X.role_from_title(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == titles


def test_logs_and_experiments(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"date":"2021-01-04","ticker":"A","action":"BUY","price":1.5}\nnot json\n')
    assert io.read_trade_log(spark, str(tmp_path / "log.jsonl")).count() == 1
    assert io.read_log_with_errors(spark, str(tmp_path / "log.jsonl")).count() == 2
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.json").write_text('{"experiment": "x",\n "strategy": {"metrics": {"sharpe": 0.9}, "window_results": [{"iteration": 1, "total_return": 2.0}]}, "buy_and_hold": {"sharpe": 0.7}}')
    e = io.read_experiments(spark, str(tmp_path / "e" / "*.json"))
    assert e.first()["n_windows"] == 1 and e.first()["file"] == "x.json"
    assert reports.window_table(e).first()["total_return"] == 2.0
    (tmp_path / "c.csv").write_text("Date,equity\n2021-01-04,1.0\n2021-01-05,\n")
    assert io.read_equity_csv(spark, str(tmp_path / "c.csv")).filter("equity is null").count() == 1
    (tmp_path / "u.csv").write_text("ticker,name,asset_class,sector,notes\nB,b,equity,x,\nA,a,bond,y,\n")
    assert [(r["symbol"], r["symbol_rank"]) for r in io.read_universe(spark, str(tmp_path / "u.csv")).collect()] == [("B", 0), ("A", 1)]


def test_upsert_keeps_the_last(spark):
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 1)], [(2, 5), (2, 3), (3, 1)]))
    assert sorted(map(tuple, io.upsert(a, b, ["k"]).collect())) == [(1, 1), (2, 5), (3, 1)]


def test_classifier_learns_and_keeps_missing_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    rows = [(DAYS[i % 100], f"s{i // 100}", float(v), float(v > 0)) for i, v in enumerate(x)] + [(DAYS[0], "none", None, None)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double, target_binary double")
    model = models.CalibratedClassifier(["x"], trees=2, depth=2, k=2)
    got = model.fit(df).predict(df).toPandas()
    assert got["probability"].isna().sum() == 1 and ((got["probability"] > 0.5) == (got["x"] > 0))[got["x"].notna()].mean() > 0.9
    assert model.feature_importances()[0][0] == "x"
    assert models.CalibratedClassifier(["x"], least=1000).fit(df).predict(df).filter("probability is not null").count() == 0


def test_forest_and_hmm(spark):
    rng = np.random.default_rng(1)
    calm, wild = rng.normal(14, 1, 120), rng.normal(35, 2, 60)
    vix = np.concatenate([calm, wild, [35.0] * 20])
    rows = [(1, pd.bdate_range("2020-01-01", periods=200)[i].date(), "train" if i < 180 else "val", float(v), float(v) / 1000) for i, v in enumerate(vix)]
    df = spark.createDataFrame(rows, "iteration int, date date, split string, vix double, vol_20d double")
    got = models.hmm_states(df, ["vix", "vol_20d"], states=2).toPandas()
    assert len(got) == 20 and (got["crisis_probability"] > 0.9).all()
    forest = models.IsolationForest(["vix"], trees=30).fit(df.filter("vix < 20"))
    scores = forest.predict(spark.createDataFrame([(14.0,), (60.0,), (None,)], "vix double")).toPandas()["score"]
    assert scores[1] < scores[0] and pd.isna(scores[2])


def test_headlines(spark):
    df = spark.createDataFrame([("profit beats",), ("weak loss",), ("board meets",), (None,)], "headline string")
    assert {r["headline"]: r["score"] for r in models.score_headlines(df).collect()} == {"profit beats": 1.0, "weak loss": 0.0, "board meets": 0.5, None: None}


def test_folds_are_contiguous_blocks_of_each_label(spark):
    rng = np.random.default_rng(4)
    rows = [(DAYS[int(i)], f"s{n}", float(y)) for n, (i, y) in enumerate(zip(rng.integers(0, 30, 300), rng.integers(0, 2, 300), strict=True))] + [(DAYS[3], "none", None)]
    df = spark.createDataFrame(rows, "date date, symbol string, y double")
    got = {r["symbol"]: r["fold"] for r in models.with_folds(df, "y", 5, ["date", "symbol"]).collect()}
    for label in (0.0, 1.0, None):
        ordered = sorted((d, s) for d, s, y in rows if y == label)
        assert [got[s] for _, s in ordered] == [min(k * 5 // len(ordered), 4) for k in range(len(ordered))]


def test_isotonic_calibration_equals_pooled_neighbours(spark):
    rng = np.random.default_rng(5)
    m = np.sort(rng.normal(size=60))
    y = (m + rng.normal(size=60) > 0).astype(float)
    blocks = []  # pool adjacent violators, one by one
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, n), (b, k) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * k) / (n + k), n + k]]
    want = np.repeat([v for v, _ in blocks], [n for _, n in blocks])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, y, strict=True)], "m double, y double")
    curve = models.fit_calibration(df, "m", "y", "isotonic")
    got = df.select("m", curve(F.col("m")).alias("p"), curve(F.col("m") - 100).alias("low"), curve(F.col("m") + 100).alias("high")).orderBy("m").toPandas()
    assert got["p"].to_numpy() == pytest.approx(want) and set(got["low"]) == {want[0]} and set(got["high"]) == {want[-1]}


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_models_calibrated_over_folds(spark, method):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    rows = [(DAYS[i % 100], f"s{i // 100}", float(v), float(v + rng.normal() / 2 > 0)) for i, v in enumerate(x)] + [(DAYS[0], "none", None, None)]
    df = spark.createDataFrame(rows, "date date, symbol string, x double, target_binary double")
    model = models.LogisticModel(["x"], target="p", k=4, method=method).fit(df)
    got = model.predict(df).toPandas()
    known = got[got["x"].notna()]
    assert len(model.folds) == 4 and got["p"].isna().sum() == 1 and known["p"].between(0, 1).all()
    assert ((known["p"] > 0.5) == (known["target_binary"] > 0)).mean() > 0.8
    assert not models.LogisticModel(["x"], k=4).fit(df.limit(30)).folds
    trees = models.CalibratedClassifier(["x"], trees=2, depth=2, k=2, method=method).fit(df).predict(df).toPandas()
    assert ((trees["probability"] > 0.5) == (trees["target_binary"] > 0))[trees["x"].notna()].mean() > 0.8


def test_sessions_that_are_and_were(spark):
    cal = spark.createDataFrame([(d,) for d in DAYS[:3]], "date date")
    df = spark.createDataFrame([(dt.date(2021, 1, d),) for d in (2, 4, 6, 7, 30)], "d date")
    got = {r["d"].day: (r["is_session"], r["last_session"] and r["last_session"].day) for r in asof.last_session(asof.is_session(df, "d", cal), "d", cal).collect()}
    assert got == {2: (False, None), 4: (True, 4), 6: (True, 6), 7: (False, 6), 30: (False, 6)}


def test_the_sink_over_several_batches(spark, tmp_path):
    keys, schema, path = ["k"], "k int, v int", f"file://{tmp_path}/t"
    sink = daily.upsert_sink(spark, path, keys, schema)
    read = lambda p=path: sorted(map(tuple, daily.read_upserted(spark, p, keys, schema).collect()))
    assert read() == []
    batches = [[(1, 1), (2, 1)], [(2, 2), (3, 2), (3, 3)], [(1, 9)]]
    for n, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), n)
    sink(spark.createDataFrame(batches[1], schema), 1)  # a batch that is tried again
    assert read() == [(1, 9), (2, 2), (3, 3)]
    daily.compact(spark, path, f"file://{tmp_path}/u", keys, schema, 1)
    assert read(f"file://{tmp_path}/u") == [(1, 9), (2, 2), (3, 3)]


def test_curves_without_a_panel_equal_the_filled_panel(spark):
    rng = np.random.default_rng(8)
    rows = [(s, DAYS[i], float(rng.uniform(5, 20)) if rng.random() > 0.1 else None) for s in "ABCDE" for i in range(60) if rng.random() > 0.4 or (s in "AB" and i == 0)]
    rows += [("Z", DAYS[0], -1.0), ("Z", DAYS[9], 3.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    pdf = pd.DataFrame(rows, columns=["symbol", "date", "close"]).pivot(index="date", columns="symbol", values="close").sort_index()
    first, filled = pdf.iloc[0], pdf.ffill()
    want = pd.concat([(0.9992 * filled[s].fillna(first[s]) / first[s]) if first[s] > 0 else pd.Series(1.0, filled.index) for s in pdf], axis=1).mean(axis=1) * 10_000
    got = ledger.buy_and_hold(df).orderBy("date").toPandas()
    assert got["equity"].to_numpy() == pytest.approx(want.to_numpy())
    curve, _ = ledger.sma_crossover(df, 2, 4)
    sleeves = ledger.sma_sleeves(df, 2, 4, 10_000 / pdf.shape[1]).toPandas().pivot(index="date", columns="symbol", values="equity").sort_index().ffill()
    assert curve.orderBy("date").toPandas()["equity"].to_numpy() == pytest.approx(sleeves.sum(axis=1).to_numpy())
