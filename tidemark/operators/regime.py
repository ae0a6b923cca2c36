"""Market-level features by date, and what follows from them for sizing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import guarded, ratio
from ..sources.io import landed
from .asof import asof_backward, densify
from .features import returns, volume_ratio
from .quantiles import percentiles


def daily_returns(bars: DataFrame) -> DataFrame:
    """(symbol, date, ret): the return against the symbol's previous bar."""
    return bars.select("symbol", "date", returns(1).alias("ret"))


def realized_vol(rets: DataFrame, window: int) -> DataFrame:
    vol = guarded(F.stddev_samp, F.col("ret"), window, max(window // 2, 3))
    return rets.select("date", vol.alias("v")).groupBy("date").agg(F.avg("v").alias(f"vol_{window}d"))


def market_breadth(rets: DataFrame) -> DataFrame:
    up = F.sum(F.when(F.col("ret") > 0, 1.0).otherwise(F.when(F.col("ret").isNotNull(), 0.0)))
    return rets.groupBy("date").agg(ratio(up, F.count("ret").cast("double")).alias("market_breadth"))


def avg_volume_ratio(bars: DataFrame, window: int = 20) -> DataFrame:
    return bars.select("date", volume_ratio(window).alias("v")).groupBy("date").agg(F.avg("v").alias("avg_volume_ratio"))


#: Symbols of a block of the rolling correlation, on average, at least and at most; blocks are larger where more than `_BLOCKS` would be needed.
SYMBOL_BLOCK, LARGEST_BLOCK, _BLOCKS = 256, 2048, 48
#: Windows whose spread is a smaller part of their squares are worked again around their means.
_THIN = 1e-3


#: Symbols that one symbol is worked against at once, so that arrays stay near the processor.
_NEAR = 64


def _last(rows: np.ndarray, window: int, spare: np.ndarray) -> np.ndarray:
    """At every place of each row, the sum of the `window` values that end there, put together from sums of 1, 2, 4 ... values, so nothing is ever taken off.

    `spare` is room for three such arrays.
    """
    (out, other), done, power, n = spare[:2], 0, rows, 1
    while True:
        if window & n:
            if done:
                out[:, done:] += power[:, :-done]
            else:
                out[:] = power
            done += n
        n *= 2
        if n > window:
            return out
        np.add(power[:, n // 2 :], power[:, : -(n // 2)], out=other[:, n // 2 :])
        other[:, : n // 2] = power[:, : n // 2]
        power, other = other, power if power is not rows else spare[2]


class _Days:
    """Sums and numbers of correlations by date, and the dates on which any pair has returns."""

    def __init__(self, days: np.ndarray, window: int, least: int):
        self.days, self.window, self.least = days, window, least
        self.total, self.n, self.met = np.zeros(len(days)), np.zeros(len(days), np.int64), np.zeros(len(days), bool)
        self.room = np.empty(0)

    def add(self, counts: np.ndarray, day: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One symbol against others: their common returns, so many of each, in order of (other, date)."""
        if not len(day):
            return
        self.met[day] = True
        others, number = len(counts), np.arange(len(day))
        place = number - np.repeat(np.cumsum(counts) - counts, counts)
        at = number + np.repeat((self.window - 1) * np.arange(1, others + 1), counts)  # nothing lies between others, so windows don't cross
        width = max(len(day) + (self.window - 1) * (others + 1), 2 * self.window)
        if len(self.room) < 20 * width:
            self.room = np.empty(30 * width)
        flat, *spare = self.room[: 20 * width].reshape(4, 5, width)
        flat[:2] = 0
        flat[0, at], flat[1, at] = x, y
        np.multiply(flat[0], flat[0], out=flat[2])
        np.multiply(flat[1], flat[1], out=flat[3])
        np.multiply(flat[0], flat[1], out=flat[4])
        full = np.flatnonzero(place >= self.least - 1)
        if not len(full):
            return
        at, day, n = (v.take(full, mode="clip") for v in (at, day, place))  # places are in range; `clip` spares their check
        n = np.minimum(n + 1, self.window).astype(float)
        sx, sy, xx, yy, xy = (row.take(at, mode="clip") for row in _last(flat, self.window, spare))
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        xy -= sx * sy / n
        thin = np.flatnonzero((vx <= _THIN * xx) | (vy <= _THIN * yy))
        vx[thin] = vy[thin] = 1.0
        vx *= vy
        xy /= np.sqrt(vx, out=vx)
        for k in range(0, len(thin), 1 << 14):
            some = thin[k : k + (1 << 14)]
            xy[some], moved = self._again(flat, at[some], n[some])
            xy[still := some[~moved]] = 0.0
            self.n -= np.bincount(day[still], minlength=len(self.days))
        self.total += np.bincount(day, xy, len(self.days))
        self.n += np.bincount(day, minlength=len(self.days))

    def _again(self, flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(correlation, whether both sides move) of the windows that end at these places."""
        back = np.arange(self.window)[:, None]
        p, q = flat[0][at - back], flat[1][at - back]
        there = back < n
        spread = lambda v: np.where(there, v, -np.inf).max(0) > np.where(there, v, np.inf).min(0)
        moved = spread(p) & spread(q)
        off = lambda v: np.where(there, v - np.where(there, v, 0).sum(0) / n, 0)
        p, q = off(p), off(q)
        size = (p * p).sum(0) * (q * q).sum(0)
        return (p * q).sum(0) / np.sqrt(np.where(moved, size, 1.0)), moved


def _correlated(window: int, least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        dates, rets = (table[c].combine_chunks() for c in ("dates", "rets"))
        flat, values = dates.flatten().to_numpy(), rets.flatten().to_numpy()
        days, day = np.unique(flat, return_inverse=True)
        ends = np.cumsum(np.array(pc.list_value_length(dates)))
        starts = np.concatenate([[0], ends[:-1]])
        same = not side.any()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        found, here = _Days(days, window, least), np.full(len(days), np.nan)
        for k in range(0, len(right), _NEAR):
            some = right[k : k + _NEAR]
            sizes = ends[some] - starts[some]
            rows = np.repeat(starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            its_day, its = day[rows], values[rows]
            begins = np.cumsum(sizes) - sizes
            for place, a in enumerate(left):
                first = max(0, place + 1 - k) if same else 0  # a pair once
                if first >= len(some):
                    continue
                here[:] = np.nan
                here[day[starts[a] : ends[a]]] = values[starts[a] : ends[a]]
                begin = begins[first]
                x = here.take(its_day[begin:], mode="clip")
                common = np.flatnonzero(x == x)
                counts = np.diff(np.searchsorted(common, begins[first:] - begin), append=len(common))
                found.add(counts, *(v.take(common, mode="clip") for v in (its_day[begin:], x, its[begin:])))
        met = np.flatnonzero(found.met)
        return pa.table({"date": pa.array(days[met], pa.int32()).cast(pa.date32()), "total": pa.array(found.total[met]), "n": pa.array(found.n[met])})

    return run


def rolling_avg_correlation(rets: DataFrame, window: int = 20, symbol_block: int = SYMBOL_BLOCK) -> DataFrame:
    """Mean over symbol pairs of their rolling correlation over the last `window` dates that both have, from max(window // 2, 5) of them on.

    A symbol's returns are one row of arrays. Symbols are dealt into blocks, and a task takes two blocks (or one with itself): the common returns of one symbol and
    the others lie one after the other, and the sums of all their windows come from a few passes over arrays. So pairs are never rows: a symbol is copied once a block,
    and a date leaves a task as one sum and one count. Exact for any gaps. (symbol, date) is a key. A pair's window with a symbol that stands still has no correlation; a date without any is null.
    """
    rows = rets.select("date", F.col("symbol").cast("string").alias("symbol"), "ret").dropna()
    past = F.sort_array(F.collect_list(F.struct(F.unix_date("date").alias("d"), F.col("ret").cast("double").alias("r"))))
    series = landed(rows.groupBy("symbol").agg(past.alias("_p")).select("symbol", F.col("_p.d").alias("dates"), F.col("_p.r").alias("rets")), "returns")
    symbols = series.count()
    blocks = max(1, -(-symbols // min(max(symbol_block, -(-symbols // _BLOCKS)), max(symbol_block, LARGEST_BLOCK))))
    own, other = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"), F.col("_other")
    dealt = series.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = F.least("_own", other) * blocks + F.greatest("_own", other)
    cells = dealt.select(cell.alias("cell"), (F.col("_own") > other).cast("int").alias("side"), "dates", "rets")
    found = cells.repartition(blocks * (blocks + 1) // 2, "cell").groupBy("cell").applyInArrow(_correlated(window, max(window // 2, 5)), "date date, total double, n long")
    return found.groupBy("date").agg(F.when(F.sum("n") > 0, F.sum("total") / F.sum("n")).alias("avg_correlation"))


def complete_avg_correlation(rets: DataFrame, window: int = 20) -> DataFrame:
    """The same mean for symbols without gaps, in time proportional to rows * window.

    With returns standardised inside each window, the pairs' correlations add up to ((sum of z)^2 per day, summed) / (w - 1)
    less the number of symbols. A date needs full windows; symbols that don't move or have gaps there are left out.
    """
    ordered = Window.partitionBy("symbol").orderBy("date")
    frame = ordered.rowsBetween(-(window - 1), 0)
    rows = rets.dropna().withColumns({"n": F.count("ret").over(frame), "m": F.avg("ret").over(frame), "s": F.stddev_samp("ret").over(frame), "past": F.collect_list(F.struct("date", "ret")).over(frame)})
    rows = rows.filter((F.col("n") == window) & (F.col("s") > 0))
    z = rows.select("date", "symbol", F.explode("past").alias("p"), "m", "s").select("date", "symbol", F.col("p.date").alias("day"), ((F.col("p.ret") - F.col("m")) / F.col("s")).alias("z"))
    daily = z.groupBy("date", "day").agg(F.sum("z").alias("z"), F.count(F.lit(1)).alias("n"))
    sums = daily.groupBy("date").agg(F.sum(F.col("z") * F.col("z")).alias("q"), F.max("n").cast("double").alias("n"))
    return sums.select("date", F.when(F.col("n") > 1, (F.col("q") / (window - 1) - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("avg_correlation"))


def align_asof(series: DataFrame, dates: DataFrame, value: str = "close", target: str = "vix") -> DataFrame:
    """The index level as of each date."""
    return asof_backward(dates, series, [], "date", value, target)


def measures_by_date(bars: DataFrame, windows: Sequence[int] = (5, 20, 60), volume_window: int = 20) -> DataFrame:
    """vol_{w}d, avg_volume_ratio and market_breadth of each date: one stage of windows over the symbols and one aggregate."""
    rows = bars.select("symbol", "date", returns(1).alias("ret"), volume_ratio(volume_window).alias("vr"))
    rows = rows.select("date", "ret", "vr", *[guarded(F.stddev_samp, F.col("ret"), w, max(w // 2, 3)).alias(f"v{w}") for w in windows])
    up = F.sum(F.when(F.col("ret") > 0, 1.0).otherwise(F.when(F.col("ret").isNotNull(), 0.0)))
    return rows.groupBy("date").agg(*[F.avg(f"v{w}").alias(f"vol_{w}d") for w in windows], F.avg("vr").alias("avg_volume_ratio"), ratio(up, F.count("ret").cast("double")).alias("market_breadth"))


def build_regime_features(bars: DataFrame, index: DataFrame, correlation: bool = True) -> DataFrame:
    """One row per date: vol_5d, vol_20d, vol_60d, vix, avg_correlation (if asked for), avg_volume_ratio, market_breadth."""
    out = align_asof(index, measures_by_date(bars))
    return out.join(rolling_avg_correlation(daily_returns(bars)), "date", "left") if correlation else out


def common_returns(bars: DataFrame) -> DataFrame:
    """(symbol, date, ret) on the dates of all symbols: a symbol's return where it and its date before have a close, else null.

    The long form of a matrix of returns; dates and symbols are dimensions, so the panel is a row for each of both.
    """
    panel = densify(bars.select("symbol", "date", "close"), bars.select("date").distinct(), bars.select("symbol").distinct())
    return daily_returns(panel)


def train_percentile(df: DataFrame, col: str, p: float) -> DataFrame:
    """The linearly interpolated percentile, as one row; found by counting when this is called."""
    return percentiles(df, col, [p]).select("threshold")


def dynamic_kelly_fraction(days: DataFrame, train: DataFrame, percentile: float = 70.0, base: float = 0.5, boost: float = 0.6) -> DataFrame:
    """`rho` per date: boosted when the index is below the training percentile, the scale is full and nothing is vetoed."""
    cut = F.broadcast(train_percentile(train, "vix", percentile))
    calm = (F.col("vix") < F.col("threshold")) & (F.coalesce("scale", F.lit(1.0)) >= 1) & (F.coalesce("veto", F.lit(0)) == 0)
    return days.join(cut, how="cross").withColumn("rho", F.when(calm, F.lit(boost)).otherwise(F.lit(base))).drop("threshold")


def soft_scale(score: Column, low: Column, high: Column, severe: float = 0.25, moderate: float = 0.6) -> Column:
    return F.when(score < low, F.lit(severe)).when(score < high, F.lit(moderate)).otherwise(F.lit(1.0))


def binary_veto(score: Column, threshold: Column) -> Column:
    return F.when(score < threshold, F.lit(1)).otherwise(F.lit(0))


def rank_scale(rank: Column, states: int, severe: float = 0.25, moderate: float = 0.6, veto_from: int | None = None) -> tuple[Column, Column]:
    """Scale and veto of a risk rank, 0 the calmest."""
    scale = F.when(rank == 0, F.lit(1.0)).when(rank >= states - 1, F.lit(severe)).otherwise(F.lit(moderate))
    return scale, F.when(rank >= (states - 1 if veto_from is None else veto_from), F.lit(1)).otherwise(F.lit(0))


def hybrid(a: DataFrame, b: DataFrame) -> DataFrame:
    """The stricter of two verdicts (date, score, scale, veto) for each date."""
    y = b.select("date", F.col("score").alias("_s"), F.col("scale").alias("_c"), F.col("veto").alias("_v"))
    return a.join(y, "date").select("date", F.least("score", "_s").alias("score"), F.least("scale", "_c").alias("scale"), F.greatest("veto", "_v").alias("veto"))
