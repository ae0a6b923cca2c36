"""Queries over the driver's tables, one or more per operator, and their SQL for DuckDB."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import alerts, asof, features, ledger, metrics, quality, regime, reports, sizing
from ..sources import io
from . import adapters as A

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}
W = "(PARTITION BY symbol ORDER BY date)"


def frame(n: int, key: str = "symbol") -> str:
    return f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, col: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({col}) OVER {frame(n)} >= {n if least is None else least} THEN {fn}({col}) OVER {frame(n)} END"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(C(c), digits).alias(c) if t == "double" else C(c) for c, t in df.dtypes])


# ---- bars and their quality


@query("bars", f"WITH {A.BARS} SELECT symbol, date, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, round(volume, 9) AS volume FROM bars")
def bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.bars(spark, d), 9)


@query(
    "quality_report",
    f"""WITH {A.BARS}, g AS (SELECT *, date - lag(date) OVER {W} AS gap FROM bars)
SELECT symbol, count(*) AS n_rows, count(*) FILTER (open IS NULL) AS null_open, count(*) FILTER (high IS NULL) AS null_high, count(*) FILTER (low IS NULL) AS null_low,
  count(*) FILTER (close IS NULL) AS null_close, count(*) FILTER (volume IS NULL) AS null_volume, count(*) FILTER (gap = 0) AS duplicate_dates, count(*) FILTER (close <= 0) AS bad_closes, max(gap)::INTEGER AS max_gap,
  count(*) FILTER (close IS NULL OR gap = 0 OR close <= 0) = 0 AS passed, coalesce(max(gap) > 7, false) AS gap_warning FROM g GROUP BY symbol""",
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_report(A.bars(spark, d))


@query("integrity_checks", f"WITH {A.BARS} SELECT symbol, count(*) AS n_rows, count(*) FILTER (close IS NULL) AS null_close, count(DISTINCT date) AS n_dates, count(*) FILTER (close IS NULL) = 0 AS close_ok, count(DISTINCT date) = count(*) AS dates_ok, count(*) >= 500 AS enough_rows FROM bars GROUP BY symbol")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    return quality.integrity_checks(A.bars(spark, d), 500)


@query("filter_asset_class", f"WITH {A.BARS}, {A.UNIVERSE} SELECT symbol, count(*) AS n, round(avg(close), 4) AS close FROM bars WHERE symbol IN (SELECT symbol FROM universe WHERE asset_class = 'equity') GROUP BY symbol")
def filter_class(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.filter_asset_class(A.bars(spark, d), A.universe(spark, d))
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("close"), 4).alias("close"))


@query("with_asset_class", f"WITH {A.BARS}, {A.UNIVERSE} SELECT coalesce(asset_class, 'equity') AS asset_class, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM bars LEFT JOIN universe USING (symbol) GROUP BY 1")
def with_class(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_asset_class(A.bars(spark, d), A.universe(spark, d)).groupBy("asset_class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("n_symbols"))


START, HOLDOUT, END = dt.date(1995, 1, 1), dt.date(2001, 1, 1), dt.date(2001, 12, 31)
WINDOWS = quality.generate_windows(START, HOLDOUT, 3, 1)
WINDOWS_SQL = "win(iteration, train_start, train_end, val_start, val_end) AS (VALUES " + ", ".join("(" + str(w[0]) + ", " + ", ".join(f"DATE '{x}'" for x in w[1:]) + ")" for w in WINDOWS) + ")"


@query(
    "assign_windows",
    f"""WITH {A.BARS}, {WINDOWS_SQL}, s AS (SELECT iteration, symbol, date, CASE WHEN date BETWEEN val_start AND val_end THEN 'val' ELSE 'train' END AS split FROM bars JOIN win ON date BETWEEN train_start AND train_end OR date BETWEEN val_start AND val_end),
r AS (SELECT *, row_number() OVER (PARTITION BY iteration, symbol, split ORDER BY date DESC) AS k FROM s)
SELECT iteration, split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM r WHERE split = 'val' OR k > 1 GROUP BY 1, 2""",
)
def assign(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.assign_windows(A.bars(spark, d).select("symbol", "date"), quality.windows_frame(spark, WINDOWS))
    return rows.groupBy("iteration", "split").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("date_slice", f"WITH {A.BARS} SELECT symbol, count(*) AS n, round(sum(volume), 2) AS volume FROM bars WHERE date >= DATE '1998-01-01' AND date < DATE '1999-01-01' AND close IS NOT NULL GROUP BY symbol")
def slice_(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.complete_rows(quality.date_slice(A.bars(spark, d), dt.date(1998, 1, 1), dt.date(1999, 1, 1), inclusive=False), ["close"])
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("volume"), 2).alias("volume"))


@query("tag_period", f"WITH {A.BARS} SELECT CASE WHEN date < DATE '1999-01-01' THEN 'walkforward' WHEN date < DATE '2001-01-01' THEN 'holdout' ELSE 'paper' END AS period, count(*) AS n FROM bars GROUP BY 1")
def tags(spark: SparkSession, d: str) -> DataFrame:
    return A.bars(spark, d).groupBy(quality.tag_period(C("date"), dt.date(1999, 1, 1), dt.date(2001, 1, 1)).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("rebalance_flag", f"WITH {A.BARS} SELECT symbol AS run_id, date, (dense_rank() OVER {W} - 1) % 5 = 0 AS rebalance FROM bars")
def rebalance(spark: SparkSession, d: str) -> DataFrame:
    return quality.rebalance_flag(A.bars(spark, d).select(C("symbol").alias("run_id"), "date"), 5)


# ---- features

FEATURES_SQL = f"""f AS (SELECT symbol, date, close, volume, high, low, lag(close) OVER {W} AS prev, lead(close) OVER {W} AS nxt,
  close / nullif(lag(close, 1) OVER {W}, 0) - 1 AS return_1d, close / nullif(lag(close, 5) OVER {W}, 0) - 1 AS return_5d, close / nullif(lag(close, 20) OVER {W}, 0) - 1 AS return_20d,
  {roll("avg", "close", 20)} AS m20, {roll("avg", "close", 50)} AS m50, {roll("avg", "close", 200)} AS m200, {roll("stddev_samp", "close", 20)} AS s20, {roll("avg", "volume", 20)} AS v20 FROM bars)"""


@query(
    "window_features",
    f"""WITH {A.BARS}, {FEATURES_SQL}
SELECT symbol, date, round(return_1d, 6) AS return_1d, round(return_5d, 6) AS return_5d, round(return_20d, 6) AS return_20d, round(close / nullif(m20, 0), 6) AS close_norm,
  round(m20 / nullif(m50, 0), 6) AS sma_ratio, round(m50 / nullif(m200, 0), 6) AS sma_ratio_long, round(m20 + 2 * s20, 6) AS bb_upper, round(m20, 6) AS bb_middle, round(m20 - 2 * s20, 6) AS bb_lower,
  round(4 * s20 / nullif(m20, 0), 6) AS bb_bandwidth, round((close - m20 + 2 * s20) / nullif(4 * s20, 0), 6) AS bb_pct_b, round(volume / nullif(v20, 0), 6) AS volume_ratio,
  round(greatest(high - low, abs(high - prev), abs(low - prev)), 9) AS true_range, round(nxt / nullif(close, 0) - 1, 6) AS target_return_1d, CASE WHEN nxt IS NOT NULL THEN (nxt > close)::INT::DOUBLE END AS target_binary FROM f""",
)
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return windowed(A.bars(spark, d))


def windowed(bars: DataFrame) -> DataFrame:
    ret, up = features.target()
    rows = features.rolled(bars, [("close", 20), ("close", 50), ("close", 200), ("volume", 20)], [("close", 20)])
    m20, m50, m200, v20 = (C(features.mean_of(c, n)) for c, n in (("close", 20), ("close", 50), ("close", 200), ("volume", 20)))
    cols = {f"return_{n}d": features.returns(n) for n in (1, 5, 20)} | {"close_norm": X.ratio(C("close"), m20), "sma_ratio": X.ratio(m20, m50), "sma_ratio_long": X.ratio(m50, m200)}
    cols |= features.bands(m20, C(features.dev_of("close", 20))) | {"volume_ratio": X.ratio(C("volume"), v20), "true_range": features.true_range(), "target_return_1d": ret, "target_binary": up}
    return rows.select("symbol", "date", *[F.round(c, 9 if n == "true_range" else 6).alias(n) for n, c in cols.items()])  # ranges of prices are short decimals, with ties at 6 digits


@query(
    "ewm_features",
    f"""WITH RECURSIVE {A.BARS},
b AS (SELECT symbol, date, close, row_number() OVER {W} AS k, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr, close - lag(close) OVER {W} AS ch FROM bars),
e AS (SELECT symbol, k, date, close, close AS fast, close AS slow, 0.0::DOUBLE AS sig, tr AS an, 1.0::DOUBLE AS ad, 0.0::DOUBLE AS gn, 0.0::DOUBLE AS ln, 0.0::DOUBLE AS gn2, 0.0::DOUBLE AS ln2 FROM b WHERE k = 1
  UNION ALL
  SELECT b.symbol, b.k, b.date, b.close, b.close * 2 / 13 + e.fast * 11 / 13, b.close * 2 / 27 + e.slow * 25 / 27,
    (b.close * 2 / 13 + e.fast * 11 / 13 - b.close * 2 / 27 - e.slow * 25 / 27) * 0.2::DOUBLE + e.sig * 0.8::DOUBLE,
    e.an * 13 / 14 + b.tr, e.ad * 13 / 14 + 1, e.gn * 13 / 14 + greatest(b.ch, 0), e.ln * 13 / 14 + greatest(-b.ch, 0), e.gn2 * 27 / 28 + greatest(b.ch, 0), e.ln2 * 27 / 28 + greatest(-b.ch, 0)
  FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1)
SELECT symbol, date, round(fast - slow, 5) AS macd, round(sig, 5) AS macd_signal, round(fast - slow - sig, 5) AS macd_hist, round(CASE WHEN k >= 14 THEN an / ad END, 5) AS atr, round(CASE WHEN k >= 14 THEN an / ad / close END, 5) AS atr_pct,
  round(CASE WHEN k > 14 THEN 100 - 100 / (1 + gn / nullif(ln, 0)) END, 5) AS rsi_14, round(CASE WHEN k > 28 THEN 100 - 100 / (1 + gn2 / nullif(ln2, 0)) END, 5) AS rsi_28 FROM e""",
)
def ewm_features(spark: SparkSession, d: str) -> DataFrame:
    means = ["macd", "macd_signal", "macd_hist", "atr", "atr_pct", "rsi_14", "rsi_28"]
    return rounded(features.compute_all_features(A.bars(spark, d), wanted=means).select("symbol", "date", *means), 5)


@query("ewm_single", f"WITH RECURSIVE {A.BARS}, b AS (SELECT symbol, date, volume, row_number() OVER {W} AS k FROM bars), e AS (SELECT symbol, date, k, volume AS y FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.date, b.k, 0.1::DOUBLE * b.volume + 0.9::DOUBLE * e.y FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1) SELECT symbol, date, round(y, 5) AS smooth FROM e")
def ewm_single(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.ewm(A.bars(spark, d).select("symbol", "date", "volume"), [features.Ewm("volume", "smooth", 0.1, False)]).select("symbol", "date", "smooth"), 5)


@query(
    "forward_fill",
    f"""WITH {A.BARS}, p AS (SELECT s.symbol, c.date FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) c)
SELECT symbol, count(*) AS n, count(v) AS n_filled, round(sum(v), 3) AS total FROM (SELECT p.symbol, p.date, last_value(close IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM p LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = p.date) GROUP BY symbol""",
)
def ffill(spark: SparkSession, d: str) -> DataFrame:
    b = A.bars(spark, d).select("symbol", "date", "close")
    rows = asof.forward_fill(asof.densify(b, b.select("date").distinct(), b.select("symbol").distinct()), ["close"])
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count("close").alias("n_filled"), F.round(F.sum("close"), 3).alias("total"))


# ---- regime


@query(
    "regime_features",
    f"""WITH {A.BARS}, {A.INDEX}, r AS (SELECT symbol, date, volume, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, volume / nullif({roll("avg", "volume", 20)}, 0) AS vr FROM bars),
v AS (SELECT *, {roll("stddev_samp", "ret", 5, 3)} AS v5, {roll("stddev_samp", "ret", 20, 10)} AS v20, {roll("stddev_samp", "ret", 60, 30)} AS v60 FROM r),
g AS (SELECT date, avg(v5) AS vol_5d, avg(v20) AS vol_20d, avg(v60) AS vol_60d, avg(vr) AS avg_volume_ratio, count(*) FILTER (ret > 0) / nullif(count(ret), 0)::DOUBLE AS market_breadth FROM v GROUP BY date)
SELECT g.date, round(vol_5d, 6) AS vol_5d, round(vol_20d, 6) AS vol_20d, round(vol_60d, 6) AS vol_60d, round(i.close, 11) AS vix, round(avg_volume_ratio, 6) AS avg_volume_ratio, round(market_breadth, 6) AS market_breadth
FROM g ASOF LEFT JOIN idx i ON g.date >= i.date""",
)
def regime_features(spark: SparkSession, d: str) -> DataFrame:
    b = A.bars(spark, d)
    out = regime.build_regime_features(b, A.index_series(spark, d), correlation=False)
    return out.select(*[F.round(c, 11 if c == "vix" else 6).alias(c) if c != "date" else C(c) for c in out.columns])


@query(
    "rolling_avg_correlation",
    f"""WITH {A.BARS}, {A.UNIVERSE}, r AS (SELECT symbol, date, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars WHERE symbol IN (SELECT symbol FROM universe WHERE asset_class = 'equity')),
p AS (SELECT a.symbol || '/' || b.symbol AS symbol, a.date, a.ret AS x, b.ret AS y FROM r a JOIN r b ON a.date = b.date AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL),
c AS (SELECT date, CASE WHEN count(*) OVER {frame(20)} >= 10 AND max(x) OVER {frame(20)} > min(x) OVER {frame(20)} AND max(y) OVER {frame(20)} > min(y) OVER {frame(20)} THEN corr(x, y) OVER {frame(20)} END AS c FROM p)
SELECT date, round(avg(c), 6) AS avg_correlation FROM c GROUP BY date""",
)
def correlation(spark: SparkSession, d: str) -> DataFrame:
    b = quality.filter_asset_class(A.bars(spark, d), A.universe(spark, d))
    return rounded(regime.rolling_avg_correlation(regime.daily_returns(b)))


DAYS_SQL = f"days AS (SELECT b.date, i.close AS vix, CASE WHEN i.close < 20 THEN 1 ELSE 0 END AS veto, CASE WHEN i.close < 22 THEN 0.25 WHEN i.close < 24 THEN 0.6 ELSE 1.0 END::DOUBLE AS scale FROM (SELECT DISTINCT date FROM bars) b ASOF LEFT JOIN idx i ON b.date >= i.date)"


def days(spark: SparkSession, d: str) -> DataFrame:
    out = regime.align_asof(A.index_series(spark, d), A.bars(spark, d).select("date").distinct())
    return io.landed(out.select("date", "vix", regime.binary_veto(C("vix"), F.lit(20.0)).alias("veto"), regime.soft_scale(C("vix"), F.lit(22.0), F.lit(24.0)).alias("scale")), "days")


@query("align_asof", f"WITH {A.BARS}, {A.INDEX}, {DAYS_SQL} SELECT date, round(vix, 11) AS vix, veto, scale FROM days")
def asof_days(spark: SparkSession, d: str) -> DataFrame:
    return rounded(days(spark, d), 11)


@query("dynamic_kelly_fraction", f"WITH {A.BARS}, {A.INDEX}, {DAYS_SQL}, t AS (SELECT quantile_cont(vix, 0.7) AS q FROM days WHERE date < DATE '1998-01-01') SELECT date, CASE WHEN vix < q AND scale >= 1 AND veto = 0 THEN 0.6 ELSE 0.5 END::DOUBLE AS rho FROM days, t WHERE date >= DATE '1998-01-01'")
def dynamic_kelly(spark: SparkSession, d: str) -> DataFrame:
    rows = days(spark, d)
    cut = F.lit(dt.date(1998, 1, 1))
    return regime.dynamic_kelly_fraction(rows.filter(C("date") >= cut), rows.filter(C("date") < cut)).select("date", "rho")


@query("veto_stats", f"WITH {A.BARS}, {A.INDEX}, {DAYS_SQL} SELECT year(date)::INTEGER AS year, sum(veto)::BIGINT AS n_veto, count(*) AS n_days, round(sum(veto) * 100.0 / count(*), 2) AS veto_pct FROM days GROUP BY 1")
def veto_years(spark: SparkSession, d: str) -> DataFrame:
    return reports.veto_by_year(days(spark, d))


@query("scale_stats", f"WITH {A.BARS}, {A.INDEX}, {DAYS_SQL} SELECT count(*) FILTER (scale <= 0.25) AS n_severe, count(*) FILTER (scale > 0.25 AND scale <= 0.6) AS n_moderate, count(*) FILTER (scale > 0.6) AS n_normal, count(scale) AS n_days, round(count(*) FILTER (scale <= 0.6) * 100.0 / count(scale), 2) AS reduced_pct FROM days")
def scales(spark: SparkSession, d: str) -> DataFrame:
    return reports.scale_stats(days(spark, d))


@query("coverage_in_periods", f"WITH {A.BARS}, {A.INDEX}, {DAYS_SQL} SELECT 'p' || CASE WHEN date < DATE '1998-01-01' THEN 1 ELSE 2 END AS name, sum(veto)::BIGINT AS n_veto, count(*) AS n_days, round(sum(veto) * 100.0 / count(*), 2) AS veto_pct FROM days WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1")
def periods(spark: SparkSession, d: str) -> DataFrame:
    named = spark.createDataFrame([("p1", dt.date(1996, 1, 1), dt.date(1997, 12, 31)), ("p2", dt.date(1998, 1, 1), dt.date(1999, 12, 31))], "name string, start date, end date")
    return reports.coverage_in_periods(days(spark, d), named)


@query("top_anomalies", f"WITH {A.BARS}, {A.INDEX}, {DAYS_SQL} SELECT date, round(vix, 11) AS score, round(vix, 11) AS vix, veto FROM days WHERE vix IS NOT NULL ORDER BY round(vix, 11), date LIMIT 20")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_anomalies(rounded(days(spark, d), 11).withColumn("score", C("vix")))


@query(
    "percentile_sweep",
    f"""WITH {A.BARS}, {A.INDEX}, {DAYS_SQL}, {WINDOWS_SQL}, t AS (SELECT iteration, unnest([2.0, 5.0, 10.0])::DOUBLE AS percentile, unnest(quantile_cont(vix, [0.02, 0.05, 0.1])) AS threshold FROM days JOIN win ON date BETWEEN train_start AND train_end GROUP BY iteration),
s AS (SELECT t.iteration, t.percentile, coalesce(sum((vix < threshold)::INT), 0) * 100.0 / count(*) AS pct FROM days JOIN win w ON date BETWEEN val_start AND val_end JOIN t ON t.iteration = w.iteration GROUP BY 1, 2),
p AS (SELECT percentile, round(sum(greatest(2.0 - round(pct, 2), round(pct, 2) - 15.0, 0.0)), 4)::DOUBLE AS penalty FROM s GROUP BY 1)
SELECT percentile, penalty, row_number() OVER (ORDER BY penalty, percentile)::INTEGER AS rank FROM p""",
)
def sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.assign_windows(days(spark, d).withColumn("symbol", F.col("date").cast("string")).withColumn("score", C("vix")), quality.windows_frame(spark, WINDOWS), embargo=False)
    return reports.sweep_penalty(reports.percentile_sweep(rows.filter("split = 'train'"), rows.filter("split = 'val'"), [2, 5, 10]))


# ---- filings and news

CAL_SQL = f"{A.BARS}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM bars))"


@query(
    "insider_alerts",
    f"""WITH {CAL_SQL}, {A.FILINGS}, h AS (SELECT DISTINCT symbol, filing_date FROM filings WHERE transaction_type IN ('S', 'S-') AND role IN ('CEO', 'CFO', 'COO', 'CTO', 'President', 'Director') AND shares_sold_pct >= 0.9),
s AS (SELECT DISTINCT h.symbol, n.date AS signal_date FROM h ASOF JOIN cal b ON h.filing_date <= b.date JOIN cal n ON n.idx = b.idx + 2)
SELECT DISTINCT s.symbol, c.date FROM s JOIN cal c ON c.date BETWEEN s.signal_date AND s.signal_date + 30""",
)
def insider(spark: SparkSession, d: str) -> DataFrame:
    cal = asof.numbered_calendar(A.bars(spark, d))
    return alerts.insider_alerts(A.filings(spark, d), cal, threshold=0.9)


@query("dedupe_filings", f"WITH {A.FILINGS} SELECT symbol, trade_date, role, transaction_type, shares_sold_pct, min(filing_date) AS filing_date FROM filings GROUP BY ALL")
def dedupe(spark: SparkSession, d: str) -> DataFrame:
    return alerts.dedupe_filings(A.filings(spark, d))


@query(
    "news_sessions",
    f"""WITH {A.NEWS}, {A.WEEKDAYS}, l AS (SELECT *, timezone('America/New_York', timezone('UTC', created_at)) AS t FROM news), dd AS (SELECT *, CASE WHEN hour(t) >= 16 THEN t::DATE + 1 ELSE t::DATE END AS day FROM l)
SELECT symbol, cal.date AS session_date, round(avg(score), 10) AS sentiment_raw, count(*) AS n FROM dd ASOF JOIN cal ON dd.day <= cal.date GROUP BY 1, 2""",
)
def news_sessions(spark: SparkSession, d: str) -> DataFrame:
    cal = asof.numbered_calendar(A.weekdays(spark, d))
    rows = asof.assign_to_sessions(A.news(spark, d), cal).na.drop(subset=["session_date"])
    counts = rows.groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("n"))
    return rounded(reports.daily_sentiment(rows), 10).join(counts, ["symbol", "session_date"])


@query(
    "sentiment_coverage",
    f"""WITH {A.NEWS}, {A.WEEKDAYS}, d AS (SELECT DISTINCT symbol, created_at::DATE AS date FROM news WHERE source = 'view'), p AS (SELECT s.symbol, cal.date FROM (SELECT DISTINCT symbol FROM news) s CROSS JOIN cal)
SELECT p.symbol, count(*) AS n_days, count(d.date) AS n_with_data, round(count(d.date) * 100.0 / count(*), 1) AS coverage_pct FROM p LEFT JOIN d ON d.symbol = p.symbol AND d.date = p.date GROUP BY p.symbol""",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    n = A.news(spark, d)
    sentiment = reports.daily_sentiment(n.filter("source = 'view'").withColumn("session_date", F.to_date("created_at")), "median")
    panel = asof.densify(n.select("symbol", F.to_date("created_at").alias("date")).limit(0), A.weekdays(spark, d), n.select("symbol").distinct())
    return reports.sentiment_coverage(reports.join_sentiment(panel, sentiment))


@query("text_functions", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 0.5 + (value % 1) / 2 WHEN 'error' THEN 0.5 - (value % 1) / 2 ELSE 0.5 END AS score, json_extract_string(props, '$.k')::DOUBLE * 1000 AS amount, substr(props, 1, 5) AS head, year(ts)::INTEGER AS year FROM events")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    label = F.when(C("event_type") == "purchase", F.lit("Positive")).when(C("event_type") == "error", F.lit("negative")).otherwise(F.lit("neutral"))
    amount = F.concat(F.get_json_object("props", "$.k"), F.lit(",000"))
    return e.select("event_id", X.sentiment_to_score(label, C("value") % 1).alias("score"), X.parse_number(amount).alias("amount"), X.truncate_headline(C("props"), 5).alias("head"), X.year_of(C("ts")).alias("year"))


# ---- sizing

GLR_SQL = """glr AS (SELECT symbol, coalesce(avg(ret) FILTER (ret > 0) / nullif(avg(-ret) FILTER (ret < 0), 0), 1.0) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets WHERE ret IS NOT NULL) WHERE k <= 60 GROUP BY symbol)"""
RETS_SQL = f"rets AS (SELECT symbol, date, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM bars)"


@query("gain_loss_ratio", f"WITH {A.BARS}, {RETS_SQL}, {GLR_SQL} SELECT symbol, round(b, 6) AS b FROM glr")
def glr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sizing.gain_loss_ratio(regime.daily_returns(A.bars(spark, d))))


@query("gain_loss_ratio_daily", f"WITH {A.BARS}, {RETS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets), u AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS j FROM t WHERE k <= 252 AND ret IS NOT NULL) SELECT symbol, round(CASE WHEN count(*) > 20 THEN coalesce(avg(ret) FILTER (j <= 60 AND ret > 0) / nullif(avg(-ret) FILTER (j <= 60 AND ret < 0), 0), 1.0) ELSE 1.0 END, 6) AS b FROM u GROUP BY symbol")
def glr_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sizing.gain_loss_ratio_daily(regime.daily_returns(A.bars(spark, d))))


CAP_SQL = "CASE asset_class WHEN 'equity' THEN 0.15 WHEN 'bond' THEN 0.20 WHEN 'gold' THEN 0.10 WHEN 'defensive_equity' THEN 0.15 ELSE 0.15 END::DOUBLE"
CLASS_CAP_SQL = "CASE asset_class WHEN 'bond' THEN 0.30 WHEN 'gold' THEN 0.10 WHEN 'defensive_equity' THEN 0.30 WHEN 'international_equity' THEN 0.20 ELSE 1.0 END::DOUBLE"
#: A probability between 0.3 and 0.9 from the day's place in its range.
P_SQL = "0.3 + 0.6 * coalesce((close - low) / nullif(high - low, 0), 0.5)"
SIZED_SQL = f"""{A.BARS}, {A.UNIVERSE}, {RETS_SQL}, {GLR_SQL}, k0 AS (SELECT date, bars.symbol, coalesce(asset_class, 'equity') AS asset_class, {P_SQL} AS p, b FROM bars JOIN glr USING (symbol) LEFT JOIN universe USING (symbol)),
k AS (SELECT *, CASE WHEN b > 0 AND 0.5 * (p - (1 - p) / b) >= 0.01 THEN least(0.5 * (p - (1 - p) / b), {CAP_SQL}) ELSE 0 END AS f FROM k0),
c AS (SELECT *, sum(f) OVER (PARTITION BY date, asset_class) AS tc FROM k), c2 AS (SELECT *, CASE WHEN tc > {CLASS_CAP_SQL} THEN f * {CLASS_CAP_SQL} / tc ELSE f END AS f2 FROM c),
n AS (SELECT date, symbol, asset_class, p, f, CASE WHEN sum(f2) OVER (PARTITION BY date) > 1 THEN f2 / sum(f2) OVER (PARTITION BY date) ELSE f2 END AS fn, sum(f) OVER (PARTITION BY date) AS tf FROM c2)"""


def kelly_rows(spark: SparkSession, d: str) -> DataFrame:
    b = A.bars_once(spark, d)
    rows = quality.with_asset_class(b, A.universe(spark, d)).join(sizing.gain_loss_ratio(regime.daily_returns(b)), "symbol")
    p = 0.3 + 0.6 * F.coalesce(X.ratio(C("close") - C("low"), C("high") - C("low")), F.lit(0.5))
    rows = rows.withColumn("p", p)
    return rows.select("date", "symbol", "asset_class", "p", sizing.kelly_size(C("p"), C("b"), C("asset_class"), F.lit(0.5)).alias("f"))


@query("kelly_size", f"WITH {SIZED_SQL} SELECT date, symbol, asset_class, round(p, 6) AS p, round(f, 6) AS f FROM n")
def kelly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kelly_rows(spark, d))


@query("normalize_by_class", f"WITH {SIZED_SQL} SELECT date, symbol, round(fn, 6) AS f FROM n")
def normalized(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sizing.normalize_by_class(kelly_rows(spark, d))).select("date", "symbol", "f")


@query("normalize_simple", f"WITH {SIZED_SQL} SELECT date, symbol, round(CASE WHEN tf > 1 THEN least(f / tf, 0.15) ELSE f END, 6) AS f FROM n")
def simple(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sizing.normalize_simple(kelly_rows(spark, d))).select("date", "symbol", "f")


@query(
    "agent_alignment",
    f"""WITH {SIZED_SQL}, {A.INDEX}, {DAYS_SQL}
SELECT n.date, n.symbol, round(CASE WHEN v.veto = 1 THEN 0 ELSE n.p END, 6) AS signal, round(n.f * coalesce(v.scale, 1.0) * CASE WHEN n.p > 0.8 THEN 0.5 ELSE 1 END, 6) AS f FROM n LEFT JOIN days v ON v.date = n.date""",
)
def alignment(spark: SparkSession, d: str) -> DataFrame:
    rows, regime_days = kelly_rows(spark, d), days(spark, d).select("date", "veto", "scale")
    none = rows.select("symbol", "date").limit(0)
    grid = sizing.align_signals(rows, none.withColumn("analyst", F.lit(0.0)), rows.filter("p > 0.8").select("symbol", "date", F.lit(1).alias("alert")), regime_days)
    f = sizing.scale_on_alert(sizing.scale_by_date(C("f"), C("scale")), C("alert"))
    grid = grid.withColumn("f", f).withColumn("signal", sizing.combine_agents(C("p"), C("analyst"), F.lit(0)))
    return rounded(sizing.apply_veto(grid, regime_days).select("date", "symbol", "signal", "f"))


@query(
    "defensive_rotation",
    f"""WITH {SIZED_SQL}, {A.INDEX}, {DAYS_SQL}, m AS (SELECT n.*, coalesce(v.veto, 0) = 1 OR coalesce(v.scale, 1.0) <= 0.25 + 1e-9 AS crisis FROM n LEFT JOIN days v ON v.date = n.date),
r AS (SELECT date, symbol, asset_class, f, crisis, CASE WHEN symbol IN ('1', '2', '3') THEN least(0.1, {CAP_SQL}) WHEN asset_class = 'equity' THEN 0 ELSE least(f, {CAP_SQL}) END AS g FROM m),
s AS (SELECT *, sum(g) OVER (PARTITION BY date, asset_class) AS tc FROM r), s2 AS (SELECT *, CASE WHEN tc > {CLASS_CAP_SQL} THEN g * {CLASS_CAP_SQL} / tc ELSE g END AS g2 FROM s)
SELECT date, symbol, round(CASE WHEN NOT crisis THEN f WHEN sum(g2) OVER (PARTITION BY date) > 1 THEN g2 / sum(g2) OVER (PARTITION BY date) ELSE g2 END, 6) AS f FROM s2""",
)
def rotation(spark: SparkSession, d: str) -> DataFrame:
    rows = kelly_rows(spark, d).join(days(spark, d).select("date", "veto", "scale"), "date", "left")
    return rounded(sizing.defensive_rotation(rows, ["1", "2", "3"]).select("date", "symbol", "f"))


@query(
    "weak_streak",
    f"""WITH {A.BARS}, s AS (SELECT symbol, date, ({P_SQL}) < 0.6 AS weak FROM bars), g AS (SELECT *, sum(CASE WHEN weak THEN 0 ELSE 1 END) OVER {W} AS run FROM s)
SELECT symbol AS run_id, date, sum(weak::INT) OVER (PARTITION BY symbol, run ORDER BY date)::BIGINT AS streak FROM g""",
)
def streaks(spark: SparkSession, d: str) -> DataFrame:
    p = 0.3 + 0.6 * F.coalesce(X.ratio(C("close") - C("low"), C("high") - C("low")), F.lit(0.5))
    rows = A.bars(spark, d).select(C("symbol").alias("run_id"), C("symbol"), "date", p.alias("signal"), F.lit(0.1).alias("f_star"))
    return sizing.weak_streak(rows, 0.6).select("run_id", "date", "streak")


@query(
    "daily_decisions",
    f"""WITH {SIZED_SQL}, l AS (SELECT n.*, glr.b, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM n JOIN glr USING (symbol))
SELECT date, symbol AS ticker, CASE WHEN f > 0 THEN 'BUY' ELSE 'HOLD' END AS action, round(p, 6) AS probability, round(f, 6) AS kelly_fraction, CASE WHEN f > 0 THEN 'signal' ELSE 'below_threshold' END AS reason, round(round(f, 8) * 10000, 1) AS size FROM l WHERE k = 1""",
)
def decisions(spark: SparkSession, d: str) -> DataFrame:
    b = sizing.gain_loss_ratio(regime.daily_returns(A.bars(spark, d)))
    rows = kelly_rows(spark, d).join(b, "symbol").select("date", "symbol", C("p").alias("probability"), "b", "asset_class", F.lit(0).alias("veto"))
    out = sizing.daily_decisions(rows)
    return rounded(out.select("date", "ticker", "action", "probability", "kelly_fraction", "reason", F.round(F.round("kelly_fraction", 8) * 10000, 1).alias("size")))


# ---- ledgers and metrics


@query(
    "buy_and_hold",
    f"""WITH {A.BARS}, p AS (SELECT s.symbol, c.date FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) c),
f AS (SELECT p.symbol, p.date, last_value(close IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM p LEFT JOIN bars b ON b.symbol = p.symbol AND b.date = p.date),
g AS (SELECT *, first_value(v) OVER (PARTITION BY symbol ORDER BY date) AS v0 FROM f)
SELECT date, round(avg(CASE WHEN v0 > 0 THEN 0.9992 * coalesce(v, v0) / v0 ELSE 1.0 END) * 10000, 4) AS equity FROM g GROUP BY date""",
)
def hold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.buy_and_hold(A.bars(spark, d)), 4)


SLEEVES_SQL = f"""m AS (SELECT symbol, date, close, coalesce((({roll("avg", "close", 20)}) > ({roll("avg", "close", 50)}))::INT, 0) AS pos FROM bars WHERE close > 0),
h AS (SELECT *, coalesce(lag(pos) OVER {W}, 0) AS held, coalesce(close / lag(close) OVER {W}, 1.0) AS move FROM m),
sl AS (SELECT symbol, date, exp(sum(CASE WHEN held = 1 THEN ln(move) ELSE 0 END + CASE WHEN pos <> held THEN ln(0.9992::DOUBLE) ELSE 0 END) OVER {W}) * 10000 AS equity, (pos <> held)::INT AS flipped FROM h)"""


@query("sma_sleeves", f"WITH {A.BARS}, {SLEEVES_SQL} SELECT symbol, date, round(equity, 3) AS equity, flipped FROM sl")
def sleeves(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.sma_sleeves(A.bars(spark, d), capital=10_000.0), 3)


@query(
    "sma_crossover",
    f"""WITH {A.BARS}, {SLEEVES_SQL}, p AS (SELECT s.symbol, c.date FROM (SELECT DISTINCT symbol FROM sl) s CROSS JOIN (SELECT DISTINCT date FROM sl) c),
f AS (SELECT p.symbol, p.date, last_value(equity IGNORE NULLS) OVER (PARTITION BY p.symbol ORDER BY p.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM p LEFT JOIN sl ON sl.symbol = p.symbol AND sl.date = p.date)
SELECT date, round(sum(e) / (SELECT count(DISTINCT symbol) FROM sl), 3) AS equity FROM f GROUP BY date""",
)
def crossover(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.sma_crossover(A.bars(spark, d))[0], 3)


SUMMARY_SQL = """r AS (SELECT *, coalesce(equity / nullif(lag(equity) OVER (PARTITION BY run_id ORDER BY date), 0) - 1, 0) AS ret, (equity - max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING)) / nullif(max(equity) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS dd FROM curves),
s AS (SELECT run_id, round((last(equity ORDER BY date) / nullif(first(equity ORDER BY date), 0) - 1) * 100, 2) AS total_return_pct, round(avg(ret) * 252 * 100, 2) AS annualized_return_pct, round(CASE WHEN stddev_samp(ret) > 1e-15 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0) WHEN avg(ret) > 0 THEN 'inf'::DOUBLE WHEN avg(ret) < 0 THEN '-inf'::DOUBLE ELSE 0 END, 3) AS sharpe,
  round(min(dd) * 100, 2) AS max_drawdown_pct, round(coalesce(avg(ret) * 252 / nullif(abs(min(dd)), 0), 0), 3) AS calmar, round(avg((ret > 1e-12)::INT) * 100, 2) AS win_rate_pct, count(*) AS n_days FROM r GROUP BY run_id)"""
CURVES = "curves AS (SELECT symbol AS run_id, date, close AS equity FROM bars)"


@query("summary", f"WITH {A.BARS}, {SLEEVES_SQL}, curves AS (SELECT symbol AS run_id, date, equity FROM sl), {SUMMARY_SQL} SELECT * FROM s")
def crossover_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every symbol's moving-average strategy, replayed in closed form and measured."""
    return metrics.summary(ledger.sma_sleeves(A.bars(spark, d), capital=10_000.0).withColumnRenamed("symbol", "run_id"))


@query("drawdown_series", f"WITH {A.BARS}, {CURVES}, {SUMMARY_SQL} SELECT run_id, date, round(dd, 6) AS drawdown FROM r")
def drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.drawdown_series(A.curves(spark, d)).select("run_id", "date", "drawdown"))


@query(
    "extended_metrics",
    f"""WITH {A.BARS}, {CURVES}, {SUMMARY_SQL}, x AS (SELECT run_id, pow(last(equity ORDER BY date) / first(equity ORDER BY date), 252.0 / (count(*) - 1)) - 1 AS cagr, min(dd) AS mdd, avg(ret) AS m, sqrt(avg(ret * ret) FILTER (ret < 0)) AS down, sum(ret) FILTER (ret > 0) AS g, sum(-ret) FILTER (ret < 0) AS l FROM r GROUP BY run_id)
SELECT run_id, round(cagr * 100, 2) AS cagr_pct, round(coalesce(cagr / nullif(abs(mdd), 0), 0), 3) AS calmar_cagr, round(coalesce(m / nullif(down, 0) * sqrt(252.0), 0), 3) AS sortino, round(g / l, 3) AS profit_factor FROM x""",
)
def extended(spark: SparkSession, d: str) -> DataFrame:
    return metrics.extended_metrics(A.curves(spark, d))


@query("metrics_by_period", f"WITH {A.BARS}, curves AS (SELECT symbol || CASE WHEN date < DATE '1998-06-01' THEN '|before' ELSE '|from' END AS run_id, date, close AS equity FROM bars), {SUMMARY_SQL} SELECT split_part(run_id, '|', 1) AS run_id, split_part(run_id, '|', 2) AS period, * EXCLUDE (run_id) FROM s")
def by_period(spark: SparkSession, d: str) -> DataFrame:
    return metrics.metrics_by_period(A.curves(spark, d), dt.date(1998, 6, 1))


@query(
    "compare_to_baseline",
    f"""WITH {A.BARS}, {SLEEVES_SQL}, curves AS (SELECT 'a' || symbol AS run_id, date, equity FROM sl UNION ALL SELECT 'b' || symbol, date, close FROM bars), {SUMMARY_SQL}
SELECT a.run_id[2:] AS run_id, round(a.total_return_pct - b.total_return_pct, 2) AS return_delta, round(a.sharpe - b.sharpe, 3) AS sharpe_delta, round(b.max_drawdown_pct - a.max_drawdown_pct, 2) AS drawdown_improvement, round(a.calmar - b.calmar, 3) AS calmar_delta FROM s a JOIN s b ON a.run_id[2:] = b.run_id[2:] AND a.run_id[1] = 'a' AND b.run_id[1] = 'b'""",
)
def baseline(spark: SparkSession, d: str) -> DataFrame:
    system = metrics.summary(ledger.sma_sleeves(A.bars(spark, d), capital=10_000.0).withColumnRenamed("symbol", "run_id"))
    return metrics.compare_to_baseline(system, metrics.summary(A.curves(spark, d)))


@query("rebase_100", f"WITH {A.BARS}, {CURVES} SELECT run_id, date, round(equity / first_value(equity) OVER (PARTITION BY run_id ORDER BY date) * 100, 5) AS equity FROM curves")
def rebase(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ledger.rebase_100(A.curves(spark, d)), 5)


@query(
    "chain_segments",
    f"""WITH {A.BARS}, {CURVES}, e AS (SELECT run_id, last(equity ORDER BY date) AS e FROM curves WHERE date < DATE '1998-01-01' GROUP BY 1), s AS (SELECT run_id, first(equity ORDER BY date) AS s FROM curves WHERE date >= DATE '1998-01-01' GROUP BY 1)
SELECT run_id, date, round(CASE WHEN date < DATE '1998-01-01' THEN equity ELSE coalesce(equity * e / s, equity) END, 7) AS equity FROM curves LEFT JOIN e USING (run_id) LEFT JOIN s USING (run_id)""",
)
def chained(spark: SparkSession, d: str) -> DataFrame:
    rows, cut = A.curves(spark, d), F.lit(dt.date(1998, 1, 1))
    return rounded(ledger.chain_segments(rows.filter(C("date") < cut), rows.filter(C("date") >= cut)), 7)


@query("compound", f"WITH {A.BARS}, {CURVES}, {SUMMARY_SQL} SELECT run_id, date, round(exp(sum(ln(1 + ret)) OVER (PARTITION BY run_id ORDER BY date ROWS UNBOUNDED PRECEDING)), 5) AS growth FROM r")
def compounded(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.with_returns(A.curves(spark, d)).select("run_id", "date", ledger.compound(C("ret")).alias("growth")), 5)


CAL_ROWS = f"q AS (SELECT symbol, date, {P_SQL} AS p, (lead(close) OVER {W} > close)::INT::DOUBLE AS y FROM bars QUALIFY y IS NOT NULL)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    p = 0.3 + 0.6 * F.coalesce(X.ratio(C("close") - C("low"), C("high") - C("low")), F.lit(0.5))
    return A.bars(spark, d).select("symbol", p.alias("p"), features.target()[1].alias("y")).filter("y is not null")


@query("brier_log_loss", f"WITH {A.BARS}, {CAL_ROWS} SELECT symbol, round(avg((p - y) * (p - y)), 5) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 5) AS log_loss FROM q GROUP BY symbol")
def losses(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("symbol").agg(metrics.brier(C("p"), C("y")).alias("brier"), metrics.log_loss(C("p"), C("y")).alias("log_loss"))


@query("calibration_curve", f"WITH {A.BARS}, {CAL_ROWS} SELECT greatest(ceil(p2 * 10) - 1, 0)::INTEGER AS bin, round(avg(p2), 6) AS mean_predicted, round(avg(y), 6) AS fraction_positive, count(*) AS n FROM (SELECT round(p, 9) AS p2, y FROM q) GROUP BY 1")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration_curve(scored(spark, d).withColumn("p", F.round("p", 9))))


@query("class_distribution", f"WITH {A.BARS}, {CAL_ROWS} SELECT symbol, y, count(*) AS n FROM q GROUP BY 1, 2")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return reports.class_distribution(scored(spark, d), "y", ["symbol"])


OUTCOME_SQL = "o AS (SELECT *, (nx > price)::INTEGER AS outcome FROM (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY date, trade_id) AS nx FROM trades) WHERE action = 'BUY' AND price > 0 AND nx > 0)"


@query("next_trade_outcome", f"WITH {A.TRADES}, {OUTCOME_SQL} SELECT trade_id, symbol, outcome FROM o")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.next_trade_outcome(A.trades(spark, d)).select("trade_id", "symbol", "outcome")


@query("reliability_from_trades", f"WITH {A.TRADES}, {OUTCOME_SQL} SELECT floor(round(p * 5, 9))::INTEGER AS bin, round(avg(p), 6) AS mean_predicted, round(avg(outcome), 6) AS fraction_positive, count(*) AS n FROM o WHERE p >= 0 AND p < 1 GROUP BY 1 HAVING count(*) >= 3")
def reliability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.reliability_from_trades(metrics.next_trade_outcome(A.trades(spark, d))))


@query(
    "mark_to_market",
    f"""WITH {A.BARS}, {A.FILINGS}, p AS (SELECT DISTINCT role AS account, symbol, trade_date AS entry_date, filing_date AS date FROM filings WHERE transaction_type = 'S'),
a AS (SELECT p.*, b.close AS c1 FROM p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date >= b.date), e AS (SELECT a.*, b.close AS c0 FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.entry_date >= b.date)
SELECT account, date, round(sum(coalesce(100 * c1 / nullif(c0, 0), 2 * c1, 100.0)) + 50, 3) AS value FROM e GROUP BY 1, 2""",
)
def valued(spark: SparkSession, d: str) -> DataFrame:
    pos = A.filings(spark, d).filter("transaction_type = 'S'").select(C("role").alias("account"), "symbol", C("trade_date").alias("entry_date"), C("filing_date").alias("date")).distinct()
    pos = io.landed(pos.withColumns({"quantity": F.lit(2.0), "allocated": F.lit(100.0)}), "positions")
    return rounded(ledger.mark_to_market(pos, pos.select("account", "date", F.lit(50.0).alias("cash")).distinct(), A.bars_once(spark, d)), 3)


def book_rows(spark: SparkSession, d: str) -> DataFrame:
    return A.trades(spark, d).select((C("symbol").cast("int") % 50).cast("string").alias("account"), "date", C("trade_id").alias("seq"), "symbol", "action", F.round(C("price") * 20, 2).alias("amount"))


@query("replay_book")
def book(spark: SparkSession, d: str) -> DataFrame:
    return ledger.replay_book(book_rows(spark, d)).select("account", "date", "cash", "invested", "n_positions")


POS_SQL = "pos AS (SELECT (user_id % 7)::VARCHAR AS account, user_id::VARCHAR AS symbol, round(sum(value), 2) AS allocated FROM events GROUP BY 1, 2)"


def positions(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").groupBy((C("user_id") % 7).cast("string").alias("account"), C("user_id").cast("string").alias("symbol")).agg(F.round(F.sum("value"), 2).alias("allocated"))


@query("book_state", f"WITH {POS_SQL} SELECT account, count(*) AS n_positions, round(sum(allocated), 2) AS invested, 100.0::DOUBLE AS cash, round(100 + sum(allocated), 2) AS total FROM pos GROUP BY account")
def book_totals(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    return ledger.book_state(pos, pos.select("account", F.lit(100.0).alias("cash")).distinct()).drop("positions")


@query("allocation_by_class", f"WITH {POS_SQL}, {A.UNIVERSE} SELECT account, asset_class, round(sum(allocated), 2) AS value FROM (SELECT account, coalesce(asset_class, 'equity') AS asset_class, allocated FROM pos LEFT JOIN universe USING (symbol) UNION ALL SELECT DISTINCT account, 'Cash', 100.0 FROM pos) GROUP BY 1, 2 HAVING sum(allocated) > 0")
def allocation(spark: SparkSession, d: str) -> DataFrame:
    pos = positions(spark, d)
    return ledger.allocation_by_class(quality.with_asset_class(pos, A.universe(spark, d)), pos.select("account", F.lit(100.0).alias("cash")).distinct())


# ---- reports over logs


@query("upsert", "WITH a AS (SELECT user_id, ts::DATE AS date, value, 0 AS s FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, ts::DATE, value, 1 FROM events WHERE event_type = 'click') SELECT user_id, date, value FROM a QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY s DESC, value DESC) = 1")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select("event_type", "user_id", C("ts").cast("date").alias("date"), "value")
    part = lambda kind: e.filter(C("event_type") == kind).drop("event_type")
    return io.upsert(part("view"), part("click"), ["user_id", "date"])


@query("latest_verdict", f"WITH {A.TRADES} SELECT trade_id, symbol, action FROM trades WHERE date = (SELECT max(date) FROM trades)")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    return reports.latest_verdict(A.trades(spark, d)).select("trade_id", "symbol", "action")


@query("page_trades", f"WITH {A.TRADES} SELECT date, trade_id, symbol FROM trades ORDER BY date DESC, trade_id LIMIT 25 OFFSET 50")
def page(spark: SparkSession, d: str) -> DataFrame:
    t = A.trades(spark, d).select("date", "trade_id", "symbol", "action")
    return reports.page_trades([t.filter("action = 'BUY'").drop("action"), t.filter("action = 'SELL'").drop("action")], 25, 50)[0]


@query("trades_after", f"WITH {A.TRADES} SELECT date, trade_id, symbol, (SELECT count(*) FROM trades) AS total FROM trades ORDER BY date DESC, trade_id LIMIT 25 OFFSET 50")
def page_by_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25 from the last row of the second, with the number of all rows."""
    t = A.trades(spark, d).select("date", "trade_id", "symbol", "action")
    logs, cursor = [t.filter("action = 'BUY'").drop("action"), t.filter("action = 'SELL'").drop("action")], None
    for _ in range(2):
        cursor = reports.trades_after(logs, 25, cursor)[0].collect()[-1].asDict()
    page, total = reports.trades_after(logs, 25, cursor)
    return page.join(total, how="cross")


@query("pending_days", f"WITH {A.BARS} SELECT DISTINCT date FROM bars WHERE date > DATE '2001-01-01' AND date NOT IN (SELECT date FROM bars WHERE symbol = '1' AND date > DATE '2001-01-01') AND date > (SELECT max(date) FROM bars WHERE symbol = '1' AND date <= DATE '2001-01-01')")
def pending(spark: SparkSession, d: str) -> DataFrame:
    cal = A.bars(spark, d).select("symbol", "date")
    limit = F.lit(dt.date(2001, 1, 1))
    one = cal.filter("symbol = '1'")
    rows = reports.pending_days(cal.select("date").distinct(), one.filter(C("date") <= limit), one.filter(C("date") <= limit), dt.date(1995, 1, 1))
    return rows.filter(C("date") > limit).join(one.filter(C("date") > limit).select("date"), "date", "left_anti")


EXP_SQL = f"{A.BARS}, {SLEEVES_SQL}, curves AS (SELECT symbol AS run_id, date, equity FROM sl), {SUMMARY_SQL}, x AS (SELECT run_id AS experiment, sharpe, total_return_pct AS total_return, max_drawdown_pct AS max_drawdown, calmar FROM s)"


def experiments(spark: SparkSession, d: str) -> DataFrame:
    return crossover_summary(spark, d).select(C("run_id").alias("experiment"), "sharpe", C("total_return_pct").alias("total_return"), C("max_drawdown_pct").alias("max_drawdown"), "calmar")


@query("experiment_leaderboard", f"WITH {EXP_SQL} SELECT * FROM x")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return reports.experiment_leaderboard(experiments(spark, d))


@query("select_canonical", f"WITH {EXP_SQL} SELECT * FROM x WHERE max_drawdown >= -101 ORDER BY sharpe DESC, calmar DESC, experiment LIMIT 1")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    return reports.select_canonical(experiments(spark, d), -101.0)


@query("top_kelly", f"WITH {SIZED_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM n) SELECT symbol AS ticker, round(f, 6) AS kelly_fraction FROM l WHERE k = 1 ORDER BY round(f, 6) DESC, symbol LIMIT 1")
def best_kelly(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_kelly(decisions(spark, d)).select("ticker", "kelly_fraction")


WIN_SQL = f"{EXP_SQL}, y AS (SELECT symbol AS experiment, year(date)::INTEGER AS iteration, round((last(equity ORDER BY date) / first(equity ORDER BY date) - 1) * 100, 2) AS total_return FROM sl GROUP BY 1, 2)"


def nested(spark: SparkSession, d: str) -> DataFrame:
    s = ledger.sma_sleeves(A.bars(spark, d), capital=10_000.0)
    y = s.groupBy(C("symbol").alias("experiment"), F.year("date").alias("iteration")).agg(F.round((F.max_by("equity", "date") / F.min_by("equity", "date") - 1) * 100, 2).alias("total_return"))
    none = lambda t: F.lit(None).cast(t)
    w = F.struct("iteration", none("string").alias("val_start"), none("string").alias("val_end"), "total_return", none("double").alias("sharpe"), none("double").alias("max_drawdown"), none("int").alias("n_tickers"))
    return experiments(spark, d).join(y.groupBy("experiment").agg(F.sort_array(F.collect_list(w)).alias("window_results")), "experiment").withColumn("buy_and_hold_sharpe", F.lit(0.5))


@query("window_table", f"WITH {WIN_SQL} SELECT experiment, iteration, NULL::VARCHAR AS val_start, NULL::VARCHAR AS val_end, total_return, 0.0::DOUBLE AS sharpe, 0.0::DOUBLE AS max_drawdown, 0 AS n_tickers FROM y")
def window_rows(spark: SparkSession, d: str) -> DataFrame:
    return reports.window_table(nested(spark, d))


@query("experiment_grid_rows", f"WITH {WIN_SQL} SELECT x.experiment, sharpe, x.total_return, max_drawdown, round(sharpe - 0.5, 3) AS sharpe_delta, y.total_return AS window_return FROM x LEFT JOIN y ON y.experiment = x.experiment AND y.iteration = 1999")
def grid(spark: SparkSession, d: str) -> DataFrame:
    return reports.experiment_grid_rows(nested(spark, d), 1999)


@query("latest_run_delta", f"WITH {EXP_SQL}, g AS (SELECT (experiment::INT % 5)::VARCHAR AS stack, experiment::INT AS t, sharpe, max_drawdown FROM x), l AS (SELECT * FROM g WHERE t < 5 QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t DESC) = 1), c AS (SELECT * FROM g WHERE t >= 5 QUALIFY row_number() OVER (PARTITION BY stack ORDER BY t DESC) = 1) SELECT c.stack, round(c.sharpe - l.sharpe, 3) AS sharpe_delta, round(c.max_drawdown - l.max_drawdown, 2) AS drawdown_delta, round(c.sharpe - l.sharpe, 3) >= -0.05 AS ok FROM c JOIN l USING (stack)")
def run_delta(spark: SparkSession, d: str) -> DataFrame:
    t = C("experiment").cast("int")
    g = experiments(spark, d).select((t % 5).cast("string").alias("stack"), t.alias("timestamp"), "sharpe", "max_drawdown")
    current = g.filter("timestamp >= 5").groupBy("stack").agg(F.max_by("sharpe", "timestamp").alias("sharpe"), F.max_by("max_drawdown", "timestamp").alias("max_drawdown"))
    return reports.latest_run_delta(g.filter("timestamp < 5"), current)


# ---- further operators on the same tables

TABLE_SQL = SQL["regime_features"].removeprefix("WITH ").rsplit("\nSELECT g.date", 1)[0]


@query(
    "regime_table",
    f"""WITH {TABLE_SQL}, {A.UNIVERSE}, rr AS (SELECT symbol, date, ret FROM r WHERE ret IS NOT NULL AND symbol IN (SELECT symbol FROM universe WHERE asset_class = 'equity')),
p AS (SELECT a.symbol || '/' || b.symbol AS symbol, a.date, a.ret AS x, b.ret AS y FROM rr a JOIN rr b ON a.date = b.date AND a.symbol < b.symbol),
c AS (SELECT date, CASE WHEN count(*) OVER {frame(20)} >= 10 AND max(x) OVER {frame(20)} > min(x) OVER {frame(20)} AND max(y) OVER {frame(20)} > min(y) OVER {frame(20)} THEN corr(x, y) OVER {frame(20)} END AS c FROM p),
e AS (SELECT date, avg(v5) AS vol_5d, avg(v20) AS vol_20d, avg(v60) AS vol_60d, avg(vr) AS avg_volume_ratio, count(*) FILTER (ret > 0) / nullif(count(ret), 0)::DOUBLE AS market_breadth FROM v WHERE symbol IN (SELECT symbol FROM universe WHERE asset_class = 'equity') GROUP BY date)
SELECT e.date, round(vol_5d, 6) AS vol_5d, round(vol_20d, 6) AS vol_20d, round(vol_60d, 6) AS vol_60d, round(i.close, 9) AS vix, round(k.avg_correlation, 6) AS avg_correlation, round(avg_volume_ratio, 6) AS avg_volume_ratio, round(market_breadth, 6) AS market_breadth
FROM e ASOF LEFT JOIN idx i ON e.date >= i.date LEFT JOIN (SELECT date, avg(c) AS avg_correlation FROM c GROUP BY date) k ON k.date = e.date""",
)
def regime_table(spark: SparkSession, d: str) -> DataFrame:
    b = quality.filter_asset_class(A.bars_once(spark, d), A.universe(spark, d))
    out = regime.build_regime_features(b, A.index_series(spark, d))
    return out.select(*[F.round(c, 9 if c == "vix" else 6).alias(c) if c != "date" else C(c) for c in out.columns])


@query(
    "common_returns",
    f"""WITH {A.BARS}, p AS (SELECT s.symbol, c.date, b.close FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) c LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = c.date),
r AS (SELECT symbol, date, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret FROM p)
SELECT date, count(*) AS n_symbols, count(ret) AS n, round(sum(ret), 5) AS total, round(max(ret), 6) AS best, round(min(ret), 6) AS worst FROM r GROUP BY date""",
)
def common_returns(spark: SparkSession, d: str) -> DataFrame:
    """All symbols' returns on the common dates, put together by date."""
    rows = regime.common_returns(A.bars(spark, d))
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n_symbols"), F.count("ret").alias("n"), F.round(F.sum("ret"), 5).alias("total"), F.round(F.max("ret"), 6).alias("best"), F.round(F.min("ret"), 6).alias("worst"))


@query(
    "standardize",
    f"WITH {A.BARS}, s AS (SELECT avg(close) AS m, stddev_pop(close) AS sd FROM bars WHERE date < DATE '1998-01-01') SELECT symbol, date, round((close - m) / coalesce(nullif(sd, 0), 1), 6) AS close FROM bars, s WHERE date >= DATE '1998-01-01'",
)
def standardized(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.models import standardize

    rows, cut = A.bars(spark, d).select("symbol", "date", "close"), F.lit(dt.date(1998, 1, 1))
    return rounded(standardize(rows.filter(C("date") >= cut), rows.filter(C("date") < cut), ["close"]))


@query(
    "session_lookups",
    f"WITH {A.BARS}, {A.FILINGS}, cal AS (SELECT DISTINCT date FROM bars WHERE symbol IN ('1', '2', '3')), f AS (SELECT DISTINCT trade_date FROM filings) SELECT f.trade_date, f.trade_date IN (SELECT date FROM cal) AS is_session, cal.date AS last_session FROM f ASOF LEFT JOIN cal ON f.trade_date >= cal.date",
)
def session_lookups(spark: SparkSession, d: str) -> DataFrame:
    cal = A.bars(spark, d).filter(C("symbol").isin("1", "2", "3")).select("date").distinct()
    days_ = A.filings(spark, d).select("trade_date").distinct()
    return asof.last_session(asof.is_session(days_, "trade_date", cal), "trade_date", cal)


@query("stop_loss_hit", f"WITH {A.BARS} SELECT symbol, date, close <= open - 0.5 * (high - low) AS hit FROM bars")
def stops(spark: SparkSession, d: str) -> DataFrame:
    return A.bars(spark, d).select("symbol", "date", sizing.stop_loss_hit(C("close"), C("open"), C("high") - C("low"), 0.5).alias("hit"))


@query(
    "open_rule",
    f"WITH {SIZED_SQL}, {A.INDEX}, {DAYS_SQL} SELECT n.date, n.symbol, coalesce(v.veto, 0) = 0 AND n.symbol::INT % 3 <> 0 AND n.f > 0.01 AND n.p >= 0.6 AS opens FROM n LEFT JOIN days v ON v.date = n.date",
)
def opens(spark: SparkSession, d: str) -> DataFrame:
    rows = kelly_rows(spark, d).join(days(spark, d).select("date", "veto"), "date", "left")
    return rows.select("date", "symbol", sizing.open_rule(C("veto"), C("symbol").cast("int") % 3 == 0, C("f"), C("p"), 0.6).alias("opens"))


@query(
    "agent_votes",
    f"""WITH {SIZED_SQL}, {A.INDEX}, {DAYS_SQL} SELECT n.date, n.symbol, round(n.p, 4) AS technical, round(n.f, 4) AS analyst, CASE WHEN n.p > 0.8 THEN 'alert' ELSE 'none' END AS insider,
  CASE WHEN v.veto = 1 THEN 0.0 ELSE round(v.scale, 4) END::DOUBLE AS regime, CASE WHEN n.symbol::INT % 2 = 0 THEN 0.6 END::DOUBLE AS boost FROM n LEFT JOIN days v ON v.date = n.date""",
)
def votes(spark: SparkSession, d: str) -> DataFrame:
    rows = kelly_rows(spark, d).join(days(spark, d).select("date", "veto", "scale"), "date", "left")
    rho = F.when(C("symbol").cast("int") % 2 == 0, F.lit(0.6)).otherwise(F.lit(0.5))
    v = sizing.agent_votes(C("p"), C("f"), (C("p") > 0.8).cast("int"), C("veto"), C("scale"), rho)
    return rows.select("date", "symbol", v.alias("v")).select("date", "symbol", "v.*")


@query("window_close_summary", f"WITH {A.TRADES} SELECT count(*) AS n_positions_closed, round(sum(round(price * 0.0008, 2)), 2) AS commission_closing FROM trades WHERE action = 'SELL'")
def closes(spark: SparkSession, d: str) -> DataFrame:
    sold = A.trades(spark, d).filter("action = 'SELL'").groupBy("symbol").agg(F.count(F.lit(1)).alias("n_positions_closed"), F.sum(F.round(C("price") * 0.0008, 2)).alias("commission_closing"))
    return reports.window_close_summary(sold)


@query(
    "holdout_window",
    f"""WITH {A.BARS}, s AS (SELECT symbol, date, CASE WHEN date <= DATE '2000-12-31' THEN 'train' ELSE 'val' END AS split FROM bars WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, split ORDER BY date DESC) AS k FROM s) SELECT 4 AS iteration, split, count(*) AS n FROM r WHERE split = 'val' OR k > 1 GROUP BY split""",
)
def holdout(spark: SparkSession, d: str) -> DataFrame:
    window = quality.holdout_window(START, HOLDOUT, END, len(WINDOWS) + 1)
    rows = quality.assign_windows(A.bars(spark, d).select("symbol", "date"), quality.windows_frame(spark, [window]))
    return rows.groupBy("iteration", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "daily_sentiment_median",
    f"WITH {A.NEWS} SELECT symbol, created_at::DATE AS session_date, round(median(score), 9) AS sentiment_raw FROM news GROUP BY 1, 2",
)
def median_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.daily_sentiment(A.news(spark, d).withColumn("session_date", F.to_date("created_at")), "median"), 9)


#: Titles as filings spell them, dealt to events by their id, and the roles they name.
TITLES = ["Chief Executive Officer", "C.F.O.", "chief technical officer", "Director", "EVP and COO", "Vice President", "VP Sales", "", None]
TITLE_ROLES = ["CEO", "CFO", "CTO", "Director", "COO", "President", "VP Sales", None, None]


@query(
    "owner_role",
    f"""SELECT event_id, coalesce(([{", ".join("NULL" if r is None else f"'{r}'" for r in TITLE_ROLES)}])[event_id % 9 + 1], CASE WHEN user_id % 3 = 0 THEN 'Director' WHEN user_id % 2 = 0 THEN 'Officer' ELSE 'Unknown' END) AS role FROM events""",
)
def owner_roles(spark: SparkSession, d: str) -> DataFrame:
    title = F.element_at(F.array(*[F.lit(t).cast("string") for t in TITLES]), (C("event_id") % 9 + 1).cast("int"))
    return A.table(spark, d, "events").select("event_id", X.owner_role(title, (C("user_id") % 3 == 0).cast("int"), C("user_id") % 2 == 0).alias("role"))


# ---- files


@query("read_universe", f"WITH {A.UNIVERSE} SELECT symbol, asset_class, 'x' AS sector, row_number() OVER (ORDER BY symbol_rank) - 1 AS symbol_rank FROM universe")
def universe_file(spark: SparkSession, d: str) -> DataFrame:
    path = io.work_dir(spark, "universe")
    rows = A.universe(spark, d).select(C("symbol").alias("ticker"), F.concat(F.lit("Name, of "), C("symbol")).alias("name"), "asset_class", F.lit("x").alias("sector"), F.lit("").alias("notes"), "symbol_rank")
    rows.coalesce(1).sortWithinPartitions("symbol_rank").drop("symbol_rank").write.csv(path, header=True)
    return io.read_universe(spark, path).select("symbol", "asset_class", "sector", "symbol_rank")


@query("malformed_lines", "SELECT event_id % 7 = 0 AS bad, count(*) AS n, round(sum(CASE WHEN event_id % 7 <> 0 THEN value END), 2) AS price FROM events GROUP BY 1")
def malformed(spark: SparkSession, d: str) -> DataFrame:
    path = io.work_dir(spark, "log")
    line = F.to_json(F.struct(F.lit("2021-01-04").alias("date"), C("user_id").cast("string").alias("ticker"), C("value").alias("price")))
    A.table(spark, d, "events").select(F.when(C("event_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    bad = io.read_log_with_errors(spark, path).select(C("_corrupt_record").isNotNull().alias("bad"), "price")
    good = io.read_trade_log(spark, path).agg(F.count(F.lit(1)).alias("_good"))
    out = bad.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))
    return out.join(good, how="cross").filter(C("bad") | (C("n") == C("_good"))).drop("_good")


@query(
    "read_experiments",
    f"WITH {WIN_SQL} SELECT x.experiment, x.sharpe, x.total_return, x.max_drawdown, x.calmar, count(y.iteration)::INTEGER AS n_windows, 0.5::DOUBLE AS buy_and_hold_sharpe, NULL::DOUBLE AS sma_sharpe FROM x LEFT JOIN y ON y.experiment = x.experiment GROUP BY ALL",
)
def experiment_files(spark: SparkSession, d: str) -> DataFrame:
    """One JSON file with a list of results for each tenth of the experiments, written and read."""
    path = io.work_dir(spark, "experiments")
    own = F.struct(F.struct("total_return", "sharpe", "max_drawdown", "calmar").alias("metrics"), "window_results")
    rows = nested(spark, d).select((C("experiment").cast("int") % 10).alias("g"), F.struct(F.lit("now").alias("timestamp"), "experiment", own.alias("own"), F.struct(C("buy_and_hold_sharpe").alias("sharpe")).alias("buy_and_hold")).alias("r"))
    rows.groupBy("g").agg(F.to_json(F.collect_list("r")).alias("value")).write.partitionBy("g").text(path)
    return io.read_experiments(spark, path, "own").drop("timestamp", "window_results", "file")


@query("equity_csv", f"WITH {A.BARS}, {CURVES} SELECT run_id::DOUBLE AS run_id, date, equity FROM curves")
def equity_csv(spark: SparkSession, d: str) -> DataFrame:
    path = io.work_dir(spark, "curves")
    io.write_equity_csv(A.curves(spark, d).withColumnRenamed("date", "Date"), path)
    return io.read_equity_csv(spark, path)
