"""Risk metrics as grouped aggregates: any number of curves (run_id, date, equity) in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio

C = F.col
#: Returns up to this are rounding of equal values, no wins.
LEAST_WIN = 1e-12
DAYS = 252


def _curve(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("date")


def with_returns(curves: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """`ret` against the curve's row before (0 on the first); rows without equity are left out."""
    before = F.lag("equity").over(_curve(keys))
    return curves.filter(C("equity").isNotNull()).withColumn("ret", F.coalesce(ratio(C("equity"), before) - 1, F.lit(0.0)))


def drawdown_series(curves: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    top = F.max("equity").over(_curve(keys).rowsBetween(Window.unboundedPreceding, 0))
    return curves.filter(C("equity").isNotNull()).withColumn("drawdown", ratio(C("equity") - top, top))


def sharpe(ret: Column, rf: float = 0.0) -> Column:
    """Annualised; infinite by the sign of the mean where nothing varies, 0 where that is 0 or there are no rows."""
    mean, dev = F.avg(ret) - rf / DAYS, F.coalesce(F.stddev_samp(ret), F.lit(0.0))
    flat = F.when(mean > 0, F.lit(float("inf"))).when(mean < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    return F.when(dev > 1e-15, mean / F.nullif(dev, F.lit(0.0)) * DAYS**0.5).otherwise(flat)


def sortino(ret: Column) -> Column:
    down = F.sqrt(F.avg(F.when(ret < 0, ret * ret)))
    return F.coalesce(ratio(F.avg(ret), down) * DAYS**0.5, F.lit(0.0))


def profit_factor(ret: Column) -> Column:
    gains, losses = F.sum(F.when(ret > 0, ret)), F.sum(F.when(ret < 0, -ret))
    return F.when(losses > 0, F.coalesce(gains, F.lit(0.0)) / F.nullif(losses, F.lit(0.0))).when(gains > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def summary(curves: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Total and annualised return, Sharpe, largest drawdown, Calmar, share of winning days and days of every curve; percentages with 2 digits, ratios with 3."""
    rows = drawdown_series(with_returns(curves, keys), keys)
    total = ratio(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1
    annual, worst = F.avg("ret") * DAYS, F.min("drawdown")
    return rows.groupBy(*keys).agg(
        F.round(total * 100, 2).alias("total_return_pct"),
        F.round(annual * 100, 2).alias("annualized_return_pct"),
        F.round(sharpe(C("ret")), 3).alias("sharpe"),
        F.round(worst * 100, 2).alias("max_drawdown_pct"),
        F.round(F.coalesce(ratio(annual, F.abs(worst)), F.lit(0.0)), 3).alias("calmar"),
        F.round(F.avg((C("ret") > LEAST_WIN).cast("double")) * 100, 2).alias("win_rate_pct"),
        F.count(F.lit(1)).alias("n_days"),
    )


def extended_metrics(curves: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Compound annual growth, Calmar on it, Sortino and profit factor."""
    rows = drawdown_series(with_returns(curves, keys), keys)
    growth = ratio(F.max_by("equity", "date"), F.min_by("equity", "date"))
    cagr = F.when((growth > 0) & (F.count(F.lit(1)) > 1), F.pow(growth, DAYS / F.nullif((F.count(F.lit(1)) - 1).cast("double"), F.lit(0.0))) - 1).otherwise(F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.round(cagr * 100, 2).alias("cagr_pct"),
        F.round(F.coalesce(ratio(cagr, F.abs(F.min("drawdown"))), F.lit(0.0)), 3).alias("calmar_cagr"),
        F.round(sortino(C("ret")), 3).alias("sortino"),
        F.round(profit_factor(C("ret")), 3).alias("profit_factor"),
    )


def metrics_by_period(curves: DataFrame, cut: dt.date, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    tagged = curves.withColumn("period", F.when(C("date") < F.lit(cut), F.lit("before")).otherwise(F.lit("from")))
    return summary(tagged, [*keys, "period"])


def compare_to_baseline(system: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Differences system - baseline; of drawdowns baseline - system."""
    b = baseline.select(*keys, *[C(c).alias(f"_{c}") for c in ("total_return_pct", "sharpe", "max_drawdown_pct", "calmar")])
    return system.join(b, list(keys)).select(
        *keys,
        F.round(C("total_return_pct") - C("_total_return_pct"), 2).alias("return_delta"),
        F.round(C("sharpe") - C("_sharpe"), 3).alias("sharpe_delta"),
        F.round(C("_max_drawdown_pct") - C("max_drawdown_pct"), 2).alias("drawdown_improvement"),
        F.round(C("calmar") - C("_calmar"), 3).alias("calmar_delta"),
    )


def brier(p: Column, y: Column) -> Column:
    return F.round(F.avg((p - y) * (p - y)), 5)


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.round(-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q)), 5)


def calibration_curve(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Mean prediction and share of positives in bins of equal width, closed on the right; empty bins don't show."""
    rows = df.filter(C(p).isNotNull() & C(y).isNotNull()).withColumn("bin", F.greatest(F.ceil(C(p) * bins) - 1, F.lit(0)).cast("int"))
    return rows.groupBy(*keys, "bin").agg(F.avg(p).alias("mean_predicted"), F.avg(y).alias("fraction_positive"), F.count(F.lit(1)).alias("n"))


def next_trade_outcome(trades: DataFrame) -> DataFrame:
    """BUY rows with `outcome` 1 if the symbol's next trade has a higher price; last rows and rows without a price are left out."""
    after = F.lead("price").over(Window.partitionBy("symbol").orderBy("date", "trade_id"))
    rows = trades.withColumn("_next", after).filter((C("action") == "BUY") & (C("price") > 0) & (C("_next") > 0))
    return rows.withColumn("outcome", (C("_next") > C("price")).cast("int")).drop("_next")


def reliability_from_trades(outcomes: DataFrame, bins: int = 5, least: int = 3, samples: int = 20) -> DataFrame:
    """Predicted against realised in bins closed on the left (1.0 falls out), with `least` rows or more, if there are `samples` in all."""
    rows = outcomes.filter((C("p") >= 0) & (C("p") < 1)).withColumn("bin", F.floor(F.round(C("p") * bins, 9)).cast("int"))
    out = rows.groupBy("bin").agg(F.avg("p").alias("mean_predicted"), F.avg("outcome").alias("fraction_positive"), F.count(F.lit(1)).alias("n"))
    total = outcomes.filter(C("p").isNotNull()).agg(F.count(F.lit(1)).alias("_all"))
    return out.join(F.broadcast(total), how="cross").filter((C("n") >= least) & (C("_all") >= samples)).drop("_all")
