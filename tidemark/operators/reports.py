"""Reports: sentiment, vetoes, sweeps, leaderboards and pages of logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from . import quantiles

C = F.col


def daily_sentiment(scores: DataFrame, agg: str = "mean") -> DataFrame:
    return scores.groupBy("symbol", "session_date").agg((F.median("score") if agg == "median" else F.avg("score")).alias("sentiment_raw"))


def join_sentiment(features: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Features with their day's sentiment; a missing one stays null."""
    return features.join(sentiment.withColumnRenamed("session_date", "date"), ["symbol", "date"], "left")


def sentiment_coverage(features: DataFrame) -> DataFrame:
    out = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"), F.count("sentiment_raw").alias("n_with_data"))
    return out.withColumn("coverage_pct", F.round(C("n_with_data") * 100.0 / C("n_days"), 1)).orderBy(F.desc("coverage_pct"), "symbol")


def _pct(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(ratio(part.cast("double") * 100, whole.cast("double")), F.lit(0.0)), 2)


def veto_stats(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = days.groupBy(*keys).agg(F.coalesce(F.sum("veto"), F.lit(0)).cast("long").alias("n_veto"), F.count(F.lit(1)).alias("n_days"))
    return out.withColumn("veto_pct", _pct(C("n_veto"), C("n_days")))


def scale_stats(days: DataFrame, keys: Sequence[str] = (), severe: float = 0.25, moderate: float = 0.6) -> DataFrame:
    out = days.groupBy(*keys).agg(
        F.count_if(C("scale") <= severe).alias("n_severe"), F.count_if((C("scale") > severe) & (C("scale") <= moderate)).alias("n_moderate"), F.count_if(C("scale") > moderate).alias("n_normal"), F.count("scale").alias("n_days")
    )
    return out.withColumn("reduced_pct", _pct(C("n_severe") + C("n_moderate"), C("n_days")))


def veto_by_year(days: DataFrame) -> DataFrame:
    return veto_stats(days.withColumn("year", F.year("date")), ["year"])


def coverage_in_periods(days: DataFrame, periods: DataFrame) -> DataFrame:
    """Share of vetoed days in named date ranges (name, start, end), a small dimension."""
    return veto_stats(days.join(F.broadcast(periods), C("date").between(C("start"), C("end"))), ["name"])


def top_anomalies(days: DataFrame, n: int = 20) -> DataFrame:
    return days.filter(C("score").isNotNull()).orderBy("score", "date").limit(n).select("date", "score", "vix", "veto")


def percentile_sweep(train: DataFrame, val: DataFrame, percentiles: Sequence[float]) -> DataFrame:
    """Vetoed validation days per window for each training percentile of the score; the percentiles are counted together."""
    cuts = quantiles.percentiles(train, "score", [float(p) for p in percentiles], "iteration")
    rows = val.join(F.broadcast(cuts), "iteration").withColumn("veto", (C("score") < C("threshold")).cast("int"))
    return veto_stats(rows, ["iteration", "percentile"])


def sweep_penalty(sweep: DataFrame, low: float = 2.0, high: float = 15.0) -> DataFrame:
    """Percentiles by how far their windows' activity leaves [low, high] percent, least first."""
    off = F.greatest(F.lit(low) - C("veto_pct"), C("veto_pct") - F.lit(high), F.lit(0.0))
    out = sweep.groupBy("percentile").agg(F.round(F.sum(off), 4).alias("penalty"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("penalty", "percentile")))


def experiment_leaderboard(experiments: DataFrame) -> DataFrame:
    return experiments.orderBy(F.coalesce("sharpe", F.lit(-999.0)).desc(), "experiment")


def experiment_grid_rows(experiments: DataFrame, iteration: int) -> DataFrame:
    """Metrics per experiment, the difference from buy and hold, and one window's return."""
    one = F.filter("window_results", lambda w: w["iteration"] == iteration)
    return experiments.select("experiment", "sharpe", "total_return", "max_drawdown", F.round(C("sharpe") - C("buy_and_hold_sharpe"), 3).alias("sharpe_delta"), F.get(one, F.lit(0))["total_return"].alias("window_return"))


def select_canonical(experiments: DataFrame, worst_drawdown: float = -30.0) -> DataFrame:
    return experiments.filter(C("max_drawdown") >= worst_drawdown).orderBy(F.desc("sharpe"), F.desc("calmar"), "experiment").limit(1)


def latest_verdict(log: DataFrame) -> DataFrame:
    return log.join(F.broadcast(log.agg(F.max("date").alias("date"))), "date", "left_semi")


def _all_trades(logs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def trades_after(logs: Sequence[DataFrame], limit: int, cursor: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """The `limit` rows that follow the row `cursor` (the last of the page before; None for the first page), newest first, and the number of rows in all.

    The order is that of `page_trades`; all columns take part, so pages neither overlap nor leave rows out, rows that are equal in all columns excepted: they count as
    one place. Rows newer than the cursor's date are not read where the log's files or folders tell dates, and a page costs a scan for its `limit` rows, however late it comes.
    """
    both = _all_trades(logs)
    order = ["date", *[c for c in both.columns if c != "date"]]
    rows = both
    if cursor is not None:
        at = {c: F.lit(cursor[c]).cast(both.schema[c].dataType) for c in order}
        after = C("date") < at["date"]
        same = C("date") == at["date"]
        for c in order[1:]:  # ascending, nulls first, within a date
            later = C(c).isNotNull() if cursor[c] is None else C(c) > at[c]
            after, same = after | (same & later), same & C(c).eqNullSafe(at[c])
        rows = both.filter((C("date") <= at["date"]) & after)
    return rows.orderBy(F.desc("date"), *order[1:]).limit(limit), both.agg(F.count(F.lit(1)).alias("total"))


def page_trades(logs: Sequence[DataFrame], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the logs' rows, newest first, and the number of rows in all; `trades_after` reads late pages as cheaply as early ones."""
    both = _all_trades(logs)
    return both.orderBy(F.desc("date"), *[c for c in both.columns if c != "date"]).offset(offset).limit(limit), both.agg(F.count(F.lit(1)).alias("total"))


def top_kelly(decisions: DataFrame) -> DataFrame:
    return decisions.orderBy(F.desc("kelly_fraction"), "ticker").limit(1)


def latest_run_delta(runs: DataFrame, current: DataFrame, tolerance: float = -0.05) -> DataFrame:
    """Per agent stack: the current run against the newest earlier one."""
    newest = runs.withColumn("_r", F.row_number().over(Window.partitionBy("stack").orderBy(F.desc("timestamp")))).filter("_r = 1")
    newest = newest.select("stack", C("sharpe").alias("_s"), C("max_drawdown").alias("_d"))
    out = current.join(newest, "stack").select("stack", F.round(C("sharpe") - C("_s"), 3).alias("sharpe_delta"), F.round(C("max_drawdown") - C("_d"), 2).alias("drawdown_delta"))
    return out.withColumn("ok", C("sharpe_delta") >= tolerance)


def window_close_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("n_positions_closed").alias("n_positions_closed"), F.round(F.sum("commission_closing"), 2).alias("commission_closing"))


def class_distribution(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.filter(C(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))


def window_table(experiments: DataFrame) -> DataFrame:
    """One row per experiment and window, defaults for what is missing."""
    rows = experiments.select("experiment", F.posexplode("window_results").alias("pos", "w"))
    value = lambda name, default: F.coalesce(C(f"w.{name}"), F.lit(default)).alias(name)
    return rows.select("experiment", F.coalesce("w.iteration", C("pos") + 1).alias("iteration"), "w.val_start", "w.val_end", value("total_return", 0.0), value("sharpe", 0.0), value("max_drawdown", 0.0), value("n_tickers", 0))


def pending_days(calendar: DataFrame, equity: DataFrame, logs: DataFrame, start) -> DataFrame:
    """Sessions after the last processed one (the latest date of either table, else the day before `start`) that have no log."""
    last = equity.select("date").unionByName(logs.select("date")).agg(F.coalesce(F.max("date"), F.date_sub(F.lit(start), 1)).alias("_last"))
    return calendar.join(F.broadcast(last), C("date") > C("_last")).select("date").join(logs.select("date"), "date", "left_anti")
