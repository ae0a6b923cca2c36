"""As-of joins, densified panels and session calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Days, or units of a number, in a bucket of the as-of join.
BUCKET = 64


def _bucket(df: DataFrame, on: str, size: int) -> Column:
    kind = df.schema[on].dataType
    if isinstance(kind, T.DateType):
        at = F.unix_date(F.col(on))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.unix_date(F.to_date(on))
    else:
        at = F.col(on)
    return F.floor(at / size)


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, target: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """The rows of `left` with the last non-null `value` of `right` at or before their `on`; null without one, or without an `on`.

    Time is cut into buckets. Rows meet inside their (key, bucket), where right rows come first on equal dates, so neither a long key nor a table
    without keys lies in one task. What an earlier bucket leaves is a key's list of last values, one a bucket, of which each bucket of `left` takes the one before it, as a row at
    its begin. `by` may be empty.
    """
    target, keys = target or value, list(by)
    a = left.withColumns({"_bucket": _bucket(left, on, bucket), "_side": F.lit(2), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.filter(F.col(value).isNotNull() & F.col(on).isNotNull()).select(*keys, on, _bucket(right, on, bucket).alias("_bucket"), F.lit(1).alias("_side"), F.col(value).alias("_v"))
    last = b.groupBy(*keys, "_bucket").agg(F.max_by("_v", on).alias("_v"))
    lists = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_bucket", "_v"))).alias("_lasts"))  # a row a key, an entry a bucket
    begun = a.select(*keys, "_bucket").filter("_bucket is not null").distinct()
    begun = begun.join(lists, keys) if keys else begun.join(F.broadcast(lists), how="cross")
    before = F.filter("_lasts", lambda x: x["_bucket"] < F.col("_bucket"))
    begun = begun.select(*keys, "_bucket", F.lit(0).alias("_side"), F.try_element_at(before, F.lit(-1))["_v"].alias("_v"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.when(F.col("_side") == 0, 0).otherwise(1), on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).unionByName(begun, allowMissingColumns=True)
    both = both.withColumn(target, F.when(F.col(on).isNotNull(), F.last("_v", ignorenulls=True).over(w)))
    return both.filter("_side = 2").drop("_side", "_v", "_bucket")


def densify(df: DataFrame, calendar: DataFrame, keys: DataFrame) -> DataFrame:
    """Every (key, date) with the columns of `df`, null where it has no row. The keys and the calendar are dimensions."""
    return keys.join(F.broadcast(calendar), how="cross").join(df, [*keys.columns, *calendar.columns], "left")


def forward_fill(df: DataFrame, cols: Sequence[str], key: str = "symbol", order: str = "date") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def numbered_calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """(date, idx): sessions in order, from 0. A calendar has some thousands of rows, so one ordered window is fine."""
    return dates.select(F.col(date).alias("date")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)


def session_map(calendar: DataFrame) -> DataFrame:
    """(day, session, idx): for every calendar day up to the last session, the first session at or after it."""
    before = F.lag("date").over(Window.orderBy("date"))
    return calendar.withColumn("_from", F.coalesce(F.date_add(before, 1), F.date_sub("date", 14))).select(
        F.explode(F.sequence("_from", "date")).alias("day"), F.col("date").alias("session"), "idx"
    )


def next_session(df: DataFrame, day: str, calendar: DataFrame, target: str = "session") -> DataFrame:
    """The first session at or after `day` (days up to 14 before the first session count); null past the calendar's end."""
    return df.join(F.broadcast(session_map(calendar).select(F.col("day").alias(day), F.col("session").alias(target))), day, "left")


def assign_to_sessions(news: DataFrame, calendar: DataFrame, at: str = "created_at", zone: str = "America/New_York", close_hour: int = 16) -> DataFrame:
    """`session_date` of a UTC instant: the local date, the next one from the closing hour on, then the first session from there."""
    local = F.from_utc_timestamp(F.col(at), zone)
    day = F.when(F.hour(local) >= close_hour, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    return next_session(news.withColumn("_day", day), "_day", calendar, "session_date").drop("_day")


def add_business_days(df: DataFrame, date: str, n: int, calendar: DataFrame, target: str) -> DataFrame:
    """The n-th session after the first session at or after `date`; null beyond the calendar."""
    base = session_map(calendar).select(F.col("day").alias(date), F.col("idx").alias("_idx"))
    later = calendar.select((F.col("idx") - n).alias("_idx"), F.col("date").alias(target))
    return df.join(F.broadcast(base), date, "left").join(F.broadcast(later), "_idx", "left").drop("_idx")


def is_session(df: DataFrame, day: str, calendar: DataFrame, target: str = "is_session") -> DataFrame:
    """Whether `day` is a session of the calendar (date, ...)."""
    sessions = calendar.select(F.col("date").alias(day), F.lit(True).alias("_in")).distinct()
    return df.join(sessions, day, "left").withColumn(target, F.coalesce("_in", F.lit(False))).drop("_in")


def last_session(df: DataFrame, day: str, calendar: DataFrame, target: str = "last_session") -> DataFrame:
    """The last session at or before `day`; null before the first one."""
    days = df.select(day).distinct().select(F.col(day).alias("date"))
    found = asof_backward(days, calendar.select("date", F.col("date").alias("session")), [], "date", "session", target)
    return df.join(found.withColumnRenamed("date", day), day, "left")
