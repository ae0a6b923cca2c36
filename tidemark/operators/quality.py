"""Checks of bars, slices, walk-forward windows and period tags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col


def quality_report(bars: DataFrame) -> DataFrame:
    """Per symbol: missing values, repeated dates, closes at or below 0, the longest gap in days; a gap over 7 only warns."""
    gap = F.date_diff("date", F.lag("date").over(Window.partitionBy("symbol").orderBy("date")))
    rows = bars.withColumn("_gap", gap)
    missing = [F.count_if(C(c).isNull()).alias(f"null_{c}") for c in ("open", "high", "low", "close", "volume")]
    out = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), *missing, F.count_if(C("_gap") == 0).alias("duplicate_dates"), F.count_if(C("close") <= 0).alias("bad_closes"), F.max("_gap").alias("max_gap"))
    return out.withColumns({"passed": (C("null_close") == 0) & (C("duplicate_dates") == 0) & (C("bad_closes") == 0), "gap_warning": F.coalesce(C("max_gap") > 7, F.lit(False))})


def integrity_checks(bars: DataFrame, min_rows: int = 1000) -> DataFrame:
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(C("close").isNull()).alias("null_close"), F.countDistinct("date").alias("n_dates"))
    return out.withColumns({"close_ok": C("null_close") == 0, "dates_ok": C("n_dates") == C("n_rows"), "enough_rows": C("n_rows") >= min_rows})


def with_asset_class(df: DataFrame, universe: DataFrame, default: str = "equity") -> DataFrame:
    classes = universe.select("symbol", C("asset_class").alias("_class"))
    return df.join(classes, "symbol", "left").withColumn("asset_class", F.coalesce("_class", F.lit(default))).drop("_class")


def filter_asset_class(df: DataFrame, universe: DataFrame, asset_class: str = "equity") -> DataFrame:
    """Rows of the class's symbols; all rows if the universe (a dimension) has none of them."""
    wanted = universe.filter(C("asset_class") == asset_class).select("symbol")
    return df if wanted.isEmpty() else df.join(wanted, "symbol", "left_semi")


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def date_slice(df: DataFrame, start: dt.date, end: dt.date, inclusive: bool = True) -> DataFrame:
    return df.filter((C("date") >= F.lit(start)) & ((C("date") <= F.lit(end)) if inclusive else (C("date") < F.lit(end))))


def _years_after(day: dt.date, years: int) -> dt.date:
    try:
        return day.replace(year=day.year + years)
    except ValueError:  # 29 February
        return day.replace(year=day.year + years, day=28)


def generate_windows(start: dt.date, holdout_start: dt.date, train_years: int = 3, val_years: int = 1) -> list[tuple[int, dt.date, dt.date, dt.date, dt.date]]:
    """(iteration, train_start, train_end, val_start, val_end): training grows from `start`, validation rolls up to the holdout."""
    out, val_start = [], _years_after(start, train_years)
    while val_start < holdout_start:
        val_end = min(_years_after(val_start, val_years), holdout_start) - dt.timedelta(days=1)
        out.append((len(out) + 1, start, val_start - dt.timedelta(days=1), val_start, val_end))
        val_start = val_end + dt.timedelta(days=1)
    return out


def holdout_window(start: dt.date, holdout_start: dt.date | None, end: dt.date, iteration: int) -> tuple[int, dt.date, dt.date, dt.date, dt.date] | None:
    if holdout_start is None or holdout_start > end:
        return None
    return iteration, start, holdout_start - dt.timedelta(days=1), holdout_start, end


def windows_frame(spark: SparkSession, windows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(windows), "iteration int, train_start date, train_end date, val_start date, val_end date")


#: The column of `with_next`.
NEXT = "_next_date"


def with_next(df: DataFrame) -> DataFrame:
    """Each row with the date of its symbol's next one. Written with it, rows are assigned to windows without an exchange."""
    return df.withColumn(NEXT, F.lead("date").over(Window.partitionBy("symbol").orderBy("date")))


def assign_windows(df: DataFrame, windows: DataFrame, embargo: bool = True) -> DataFrame:
    """Each row with (iteration, split) of every window it falls in; bounds count.

    A symbol's last training row goes if its label reaches the validation: with `embargo` it always goes, else only if its
    own date does. It is known by the symbol's next date, so rows are brought together before windows multiply them, or not at all if they have it already (`with_next`).
    """
    within = lambda a, b: (C("date") >= C(a)) & (C("date") <= C(b))
    rows = (df if NEXT in df.columns else with_next(df)).join(F.broadcast(windows), within("train_start", "train_end") | within("val_start", "val_end"))
    rows = rows.withColumn("split", F.when(within("val_start", "val_end") & ~within("train_start", "train_end"), F.lit("val")).otherwise(F.lit("train")))
    last = C(NEXT).isNull() | (C(NEXT) > C("train_end"))
    drop = (C("split") == "train") & last & (F.lit(True) if embargo else C("date") >= C("val_start"))
    return rows.filter(~drop).drop(NEXT, "train_start", "train_end", "val_start", "val_end")


def tag_period(date: Column, holdout_start: dt.date, paper_start: dt.date, names: Sequence[str] = ("walkforward", "holdout", "paper")) -> Column:
    first, second, third = map(F.lit, names)
    return F.when(date < F.lit(holdout_start), first).when(date < F.lit(paper_start), second).otherwise(third)


def rebalance_flag(df: DataFrame, interval: int) -> DataFrame:
    """Whether a date is a rebalance day of its run: its place among the run's dates is a multiple of the interval."""
    if interval <= 1:
        return df.withColumn("rebalance", F.lit(True))
    place = F.dense_rank().over(Window.partitionBy("run_id").orderBy("date")) - 1
    return df.withColumn("rebalance", place % interval == 0)
