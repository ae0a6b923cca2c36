"""Registered jobs that SQL can't express (folds, models), parsers, and streams with batch SQL as their oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import alerts as insiders
from ..operators import asof, features, ledger, metrics, models, quality, regime, reports, sizing, walkforward
from ..sources import filings as filed
from ..sources import io
from ..streaming import daily
from . import adapters as A
from .queries import CAL_SQL, HOLDOUT, SQL, START, WINDOWS, W, book_rows, days, query, roll, rounded, windowed

C = F.col


# ---- parsers, over documents that Spark writes from the tables


@query(
    "parse_form4",
    f"""WITH {A.FILINGS} SELECT symbol, trade_date, filing_date, role, 'S' AS transaction_type, round(shares_sold_pct * 50000 / (shares_sold_pct * 50000 + 1000), 6) AS shares_sold_pct FROM filings WHERE transaction_type = 'S'""",
)
def form4(spark: SparkSession, d: str) -> DataFrame:
    f = A.filings(spark, d)
    value = lambda tag, v: F.concat(F.lit(f"<{tag}><value>"), v.cast("string"), F.lit(f"</value></{tag}>"))
    xml = F.concat(
        F.lit('<ownershipDocument xmlns="http://www.example.com/f4"><reportingOwner><reportingOwnerRelationship><isDirector>0</isDirector><officerTitle>'), C("role"), F.lit("</officerTitle></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction>"),
        value("transactionDate", C("trade_date")), F.lit("<transactionCoding><transactionCode>"), C("transaction_type"), F.lit("</transactionCode></transactionCoding><transactionAmounts>"),
        value("transactionShares", F.format_number(C("shares_sold_pct") * 50000, 0)), value("transactionAcquiredDisposedCode", F.lit("D")), F.lit("</transactionAmounts><postTransactionAmounts>"),
        value("sharesOwnedFollowingTransaction", F.lit("1,000")), F.lit("</postTransactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"),
    )
    return filed.parse_form4(f.select("symbol", "filing_date", xml.alias("xml")))


@query(
    "explode_filing_index",
    f"WITH {A.FILINGS} SELECT symbol, '4' AS form, filing_date, symbol || '-' || filing_date AS accession, role AS document FROM (SELECT DISTINCT symbol, filing_date, role FROM filings) WHERE filing_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND role <> 'Unknown'",
)
def filing_index(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    f = A.filings(spark, d).select("symbol", "filing_date", "role").distinct()
    one = lambda c: F.collect_list(c.cast("string"))
    form = F.when(C("role") == "Unknown", F.lit("8-K")).otherwise(F.lit("4"))
    by = f.groupBy("symbol", F.year("filing_date")).agg(one(form).alias("form"), one(C("filing_date")).alias("filingDate"), one(F.concat_ws("-", "symbol", "filing_date")).alias("accessionNumber"), one(C("role")).alias("primaryDocument"))
    rows = by.select("symbol", F.to_json(F.struct("form", "filingDate", "accessionNumber", "primaryDocument")).alias("json"))
    return filed.explode_filing_index(rows, dt.date(1998, 1, 1), dt.date(1998, 12, 31))


@query("symbol_to_cik", "SELECT upper('s' || s_suppkey) AS symbol, 1000 + s_suppkey AS cik FROM supplier")
def ciks(spark: SparkSession, d: str) -> DataFrame:
    s = A.table(spark, d, "supplier")
    entry = F.create_map(C("s_suppkey").cast("string"), F.struct(F.concat(F.lit("s"), C("s_suppkey")).alias("ticker"), (C("s_suppkey") + 1000).alias("cik_str")))
    return filed.symbol_to_cik(s.select(F.to_json(entry).alias("json")))


@query("normalize_news", "SELECT event_type AS headline, ts AS created_at, 'wire' AS source, unnest(['u' || user_id, 'k' || user_id % 10]) AS symbol FROM events WHERE event_id % 7 <> 0")
def normalized_news(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    at = F.when(C("event_id") % 7 == 0, F.lit("not a time")).otherwise(C("ts").cast("string"))
    rows = e.select(C("event_type").alias("headline"), at.alias("created_at"), F.lit("wire").alias("source"), F.array(F.concat(F.lit("u"), C("user_id")), F.concat(F.lit("k"), C("user_id") % 10)).alias("symbols"))
    return filed.normalize_news(rows)


@query("trade_log", f"WITH {A.TRADES} SELECT date::VARCHAR AS date, symbol AS ticker, action, price FROM trades")
def trade_log(spark: SparkSession, d: str) -> DataFrame:
    path = io.work_dir(spark, "trades")
    io.write_trade_log(A.trades(spark, d).select("date", C("symbol").alias("ticker"), "action", "price"), path)
    return io.read_trade_log(spark, path).select("date", "ticker", "action", "price")


@query("bar_files", f"WITH {A.BARS} SELECT symbol, count(*) AS n, round(sum(close), 3) AS close FROM bars GROUP BY symbol")
def bar_files(spark: SparkSession, d: str) -> DataFrame:
    path = io.work_dir(spark, "bars")
    io.write_bars(A.bars(spark, d), path)
    return io.read_bars(spark, path, io.WRITTEN).groupBy(C("symbol").cast("string").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 3).alias("close"))


@query("bar_table", SQL["window_features"])
def bar_table(spark: SparkSession, d: str) -> DataFrame:
    """The window features over bars that were stored in buckets of symbols: no exchange after the scan."""
    path = io.work_dir(spark, "bar-table")
    io.write_bar_table(A.bars(spark, d), path)
    return windowed(io.read_bar_table(spark, path))


@query("add_business_days", f"WITH {CAL_SQL}, {A.FILINGS}, f AS (SELECT DISTINCT filing_date FROM filings) SELECT f.filing_date, n.date AS signal_date FROM f ASOF LEFT JOIN cal b ON f.filing_date <= b.date LEFT JOIN cal n ON n.idx = b.idx + 2")
def later(spark: SparkSession, d: str) -> DataFrame:
    f = A.filings(spark, d).select("filing_date").distinct()
    return asof.add_business_days(f, "filing_date", 2, asof.numbered_calendar(A.bars(spark, d)), "signal_date").select("filing_date", "signal_date")


@query("hybrid_verdict", SQL["align_asof"].replace("SELECT date, round(vix, 11) AS vix, veto, scale FROM days", "SELECT date, least(vix, 25.0) > 0 AS scored, greatest(veto, (vix < 21)::INT) AS veto, least(scale, CASE WHEN vix < 21 THEN 0.25 ELSE 1.0 END)::DOUBLE AS scale FROM days WHERE vix IS NOT NULL"))
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = days(spark, d).filter("vix is not null")
    rank = F.when(C("vix") < 21, F.lit(2)).otherwise(F.lit(0))
    scale, veto = regime.rank_scale(rank, 3)
    other = rows.select("date", F.lit(25.0).alias("score"), scale.alias("scale"), veto.alias("veto"))
    return regime.hybrid(rows.withColumn("score", C("vix")), other).select("date", (C("score") > 0).alias("scored"), "veto", "scale")


# ---- folds and models


def replay_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of many runs: each asset class and signal threshold is an account of its own."""
    uni = A.universe(spark, d)
    full = features.compute_all_features(A.bars(spark, d), wanted=["atr", "close_norm"]).select("symbol", "date", C("close").alias("price"), "atr", "close_norm")
    rows = full.join(uni, "symbol").withColumn("signal", F.greatest(F.least(0.5 + (C("close_norm") - 1) / 4, F.lit(1.0)), F.lit(0.0)))
    rows = rows.withColumn("level", F.explode(F.array(*[F.lit(x) for x in (0.50, 0.55, 0.60, 0.65)])))
    f = sizing.kelly_size(C("signal"), F.lit(1.0), C("asset_class"), F.lit(0.5))
    return rows.select(F.concat_ws("|", "asset_class", "level").alias("run_id"), "symbol", "symbol_rank", "date", "price", F.coalesce("signal", F.lit(0.0)).alias("signal"), F.when(C("signal") >= C("level"), f).otherwise(F.lit(0.0)).alias("f_star"), F.lit(0).alias("veto"), "atr")


@query("portfolio_replay")
def replay(spark: SparkSession, d: str) -> DataFrame:
    return ledger.portfolio_replay(replay_signals(spark, d), ledger.ReplayRules(hysteresis=3, close_at_end=True))


@query("replay_summary")
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = io.landed(replay(spark, d), "replayed")  # read twice
    return metrics.summary(rows.filter("kind = 'equity'").select("run_id", "date", "equity")).join(ledger.close_stats(rows), "run_id")


#: Buy and hold as in its own query, to full precision.
HOLD_SQL = """hf AS (SELECT s.symbol, c.date, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) c LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date),
hg AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM hf),
hh AS (SELECT *, first_value(v) OVER (PARTITION BY symbol ORDER BY date) AS v0 FROM hg),
bh AS (SELECT date, avg(CASE WHEN v0 > 0 THEN 0.9992 * coalesce(v, v0) / v0 ELSE 1.0 END) AS equity FROM hh GROUP BY date)"""


def _crossed(fast: int, slow: int, tag: str) -> str:
    """SQL of the sum of sleeves with other means, under names of their own."""
    f, t = roll("avg", "close", fast), roll("avg", "close", slow)
    return f"""m{tag} AS (SELECT symbol, date, close, coalesce((({f}) > ({t}))::INT, 0) AS pos FROM bars WHERE close > 0),
h{tag} AS (SELECT *, coalesce(lag(pos) OVER {W}, 0) AS held, coalesce(close / lag(close) OVER {W}, 1.0) AS move FROM m{tag}),
s{tag} AS (SELECT symbol, date, exp(sum(CASE WHEN held = 1 THEN ln(move) ELSE 0 END + CASE WHEN pos <> held THEN ln(0.9992::DOUBLE) ELSE 0 END) OVER {W}) AS equity FROM h{tag}),
d{tag} AS (SELECT date, sum(change) AS change FROM (SELECT date, equity - coalesce(lag(equity) OVER {W}, 0) AS change FROM s{tag}) GROUP BY date),
c{tag} AS (SELECT date, sum(change) OVER (ORDER BY date) AS equity FROM d{tag})"""


@query(
    "unified_curve",
    f"""WITH {A.BARS}, {_crossed(10, 30, "a")}, {_crossed(20, 50, "b")}, {HOLD_SQL},
j AS (SELECT ca.date, ca.equity AS p, cb.equity AS s FROM ca ASOF LEFT JOIN cb ON ca.date >= cb.date), k AS (SELECT j.*, bh.equity AS b FROM j ASOF LEFT JOIN bh ON j.date >= bh.date)
SELECT date, round(100 * p / first_value(p) OVER (ORDER BY date), 4) AS portfolio_value, round(100 * b / first_value(b) OVER (ORDER BY date), 4) AS buyhold_value, round(100 * s / first_value(s) OVER (ORDER BY date), 4) AS sma_value,
  CASE WHEN date < DATE '2000-01-01' THEN 'walkforward' WHEN date < DATE '2001-01-01' THEN 'holdout' ELSE 'paper' END AS period FROM k""",
)
def unified(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    bars = A.bars(spark, d)
    strategy = ledger.sma_crossover(bars, 10, 30)[0]
    return rounded(ledger.unified_curve(strategy, {"buyhold_value": ledger.buy_and_hold(bars), "sma_value": ledger.sma_crossover(bars)[0]}, dt.date(2000, 1, 1), HOLDOUT), 4)


def regime_rows(spark: SparkSession, d: str) -> DataFrame:
    """All market features of the equity symbols (of all symbols if there is no equity), written once as they are read many times: a row a date."""
    own = quality.filter_asset_class(A.bars_once(spark, d), A.universe(spark, d))
    return io.landed(regime.build_regime_features(own, A.index_series(spark, d)), "regime")


@query("isolation_forest")
def forest(spark: SparkSession, d: str) -> DataFrame:
    rows = regime_rows(spark, d)
    train = quality.date_slice(rows, START, WINDOWS[0][2])
    return models.IsolationForest(walkforward.REGIME).fit(train).predict(rows).select("date", "score")


@query("hmm_states")
def hidden_states(spark: SparkSession, d: str) -> DataFrame:
    return states_of(spark, regime_rows(spark, d))


def states_of(spark: SparkSession, market: DataFrame) -> DataFrame:
    rows = quality.assign_windows(market.withColumn("symbol", F.lit("market")), quality.windows_frame(spark, WINDOWS), embargo=False)
    return models.hmm_states(rows, walkforward.REGIME)


@query("anomaly_scores")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Forest and hidden states over every window's validation, and the lower score of both."""
    rows, parts = regime_rows(spark, d), []
    for iteration, train_start, train_end, val_start, val_end in WINDOWS:
        model = models.IsolationForest(walkforward.REGIME).fit(quality.date_slice(rows, train_start, train_end))
        parts.append(model.predict(quality.date_slice(rows, val_start, val_end)).select(F.lit(iteration).alias("iteration"), "date", C("score").alias("forest")))
    scores = reduce(DataFrame.unionByName, parts)
    states = states_of(spark, rows).select("iteration", "date", "state_rank", C("score").alias("states"))
    return scores.join(states, ["iteration", "date"]).withColumn("score", F.least("forest", "states"))


_LISTS = {name: ", ".join(f"'{w}'" for w in words) for name, words in (("up", models.POSITIVE), ("down", models.NEGATIVE))}


@query(
    "score_headlines",
    f"""WITH h AS (SELECT doc_id, list_filter(string_split_regex(lower(left(text, 512)), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w IS NULL AS none, len(list_filter(w, lambda x: x IN ({_LISTS["up"]}))) AS up, len(list_filter(w, lambda x: x IN ({_LISTS["down"]}))) AS down FROM h)
SELECT doc_id, CASE WHEN none THEN NULL WHEN up = down THEN 'neutral' WHEN up > down THEN 'positive' ELSE 'negative' END AS label, round(CASE WHEN none OR up = down THEN 0.5 WHEN up > down THEN 0.5 + (up - down) / (up + down)::DOUBLE / 2 ELSE 0.5 - (down - up) / (up + down)::DOUBLE / 2 END, 9) AS score FROM c""",
)
def headlines(spark: SparkSession, d: str) -> DataFrame:
    """The begin of every document as a headline, by the default word lists."""
    rows = A.table(spark, d, "documents").select("doc_id", C("text").alias("headline"))
    return models.score_headlines(rows).select("doc_id", "label", F.round("score", 9).alias("score"))


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    full = features.compute_all_features(A.bars(spark, d))
    return quality.with_asset_class(full, A.universe(spark, d)).withColumn("symbol_rank", C("symbol").cast("int"))


#: Production settings over all model features, with every agent.
PRODUCTION = walkforward.Settings(trees=300, folds=5, forest=100, boost=0.6, defensives=("1", "2", "3"))


@query("walk_forward")
def walk(spark: SparkSession, d: str) -> DataFrame:
    """All windows and agents: the classifier, an analyst of line sentiment, insiders' alerts, the market's anomalies and the judge over them."""
    kept = [*walkforward.CARRIED, *features.MODEL_FEATURES]  # return_1d is one of these
    rows = io.landed(quality.with_next(model_rows(spark, d).select(*kept)), "features")
    alerts = insiders.insider_alerts(insiders.dedupe_filings(A.filings(spark, d)), asof.numbered_calendar(rows))
    io.let_go(spark)
    sentiment = reports.daily_sentiment(A.line_sentiment(spark, d))
    return walkforward.walk_forward(rows, regime_rows(spark, d), WINDOWS, PRODUCTION, sentiment, alerts)[1]


# ---- streams


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = A.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_news_sessions", SQL["news_sessions"])
def stream_news(spark: SparkSession, d: str) -> DataFrame:
    """The sessions' sentiment from a stream in append mode: each session is put out once, when it has closed; a heartbeat beyond the calendar closes the last ones."""
    cal = asof.numbered_calendar(A.weekdays(spark, d))
    end = F.lit("2100-01-01").cast("date")
    sessions = asof.session_map(cal).select("day", "session").unionByName(spark.range(1).select(end.alias("day"), end.alias("session")))
    shape = "symbol string, created_at timestamp, score double"
    beats, out = io.work_dir(spark, "heartbeats"), io.work_dir(spark, "sessions")
    spark.createDataFrame([], shape).write.parquet(beats)
    news = event_stream(spark, d).select(C("user_id").cast("string").alias("symbol"), C("ts").cast("timestamp").alias("created_at"), (C("value") % 100 / 100).alias("score"))
    means = daily.news_by_session(news.unionByName(daily.session_files(spark, beats, shape)), sessions)
    daily.run_sessions(means, out, f"{out}-log")
    spark.range(1).select(F.lit(None).cast("string").alias("symbol"), end.cast("timestamp").alias("created_at"), F.lit(None).cast("double").alias("score")).write.mode("append").parquet(beats)
    daily.run_sessions(means, out, f"{out}-log")
    return rounded(spark.read.schema("symbol string, session_date date, sentiment_raw double, n_news long").parquet(out), 10).withColumnRenamed("n_news", "n")


@query("stream_upsert", "SELECT user_id, ts::DATE AS date, max(value) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """One row per user and day, worked in by an idempotent sink."""
    out = io.work_dir(spark, "daily")
    keys, schema = ["user_id", "date"], "user_id long, date date, value double"
    daily.catch_up(event_stream(spark, d).select("user_id", C("ts").cast("date").alias("date"), "value"), daily.upsert_sink(spark, out, keys, schema), f"{out}-log")
    return daily.read_upserted(spark, out, keys, schema)


@query("stream_running_book")
def stream_book(spark: SparkSession, d: str) -> DataFrame:
    e = event_stream(spark, d).filter(C("event_type").isin("purchase", "error"))
    rows = e.select((C("user_id") % 50).cast("string").alias("account"), C("ts").cast("date").alias("date"), C("event_id").alias("seq"), C("user_id").cast("string").alias("symbol"), F.when(C("event_type") == "purchase", F.lit("BUY")).otherwise(F.lit("SELL")).alias("action"), F.round(C("value") * 20, 2).alias("amount"))
    out = io.work_dir(spark, "book")
    daily.running_book(rows).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(daily.BOOK).parquet(out)
