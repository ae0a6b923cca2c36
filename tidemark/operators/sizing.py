"""Position sizing: fractional Kelly, caps, vetoes, rotation, and the decisions of a day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio

C = F.col
#: Largest share of a position by asset class, and of a class in a portfolio.
POSITION_CAPS = {"equity": 0.15, "bond": 0.20, "gold": 0.10, "defensive_equity": 0.15, "international_equity": 0.15}
CLASS_CAPS = {"bond": 0.30, "gold": 0.10, "defensive_equity": 0.30, "international_equity": 0.20}
DEFAULT_CAP, MIN_FRACTION = 0.15, 0.01


def _lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def gain_loss_ratio(rets: DataFrame, window: int = 60, tail: int | None = None, least: int = 0) -> DataFrame:
    """(symbol, b): mean gain over mean loss of the last `window` returns; 1 where either is missing or there are `least` rows or fewer.

    With `tail`, only the last `tail` rows of a symbol are looked at, missing returns included.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    rows = rets if tail is None else rets.withColumn("_t", F.row_number().over(w)).filter(C("_t") <= tail)
    rows = rows.filter(C("ret").isNotNull()).withColumn("_r", F.row_number().over(w))
    recent = C("_r") <= window
    gain = F.avg(F.when(recent & (C("ret") > 0), C("ret")))
    loss = F.avg(F.when(recent & (C("ret") < 0), -C("ret")))
    return rows.groupBy("symbol").agg(F.when(F.count(F.lit(1)) > least, F.coalesce(ratio(gain, loss), F.lit(1.0))).otherwise(F.lit(1.0)).alias("b"))


def gain_loss_ratio_daily(rets: DataFrame) -> DataFrame:
    return gain_loss_ratio(rets, 60, tail=252, least=20)


def kelly_size(p: Column, b: Column, asset_class: Column, rho: Column, caps: Mapping[str, float] = POSITION_CAPS, least: float = MIN_FRACTION) -> Column:
    """rho * (p - (1 - p) / b), 0 if it is too small or b isn't positive, at most the class's cap."""
    f = rho * (p - ratio(1 - p, b))
    capped = F.least(f, _lookup(asset_class, caps, DEFAULT_CAP))
    return F.when((b > 0) & (f > 0) & (f >= least), capped).otherwise(F.lit(0.0))


def normalize_simple(df: DataFrame, keys: Sequence[str] = ("date",), cap: float = DEFAULT_CAP) -> DataFrame:
    total = F.sum("f").over(Window.partitionBy(*keys))
    return df.withColumn("f", F.when(total > 1, F.least(C("f") / total, F.lit(cap))).otherwise(C("f")))


def normalize_by_class(df: DataFrame, keys: Sequence[str] = ("date",), caps: Mapping[str, float] = POSITION_CAPS, class_caps: Mapping[str, float] = CLASS_CAPS) -> DataFrame:
    """Cap each position, then scale each class to its cap, then everything to a total of 1. `keys` should hold the run."""
    df = df.withColumn("f", F.least(C("f"), _lookup(C("asset_class"), caps, DEFAULT_CAP)))
    cap, total = _lookup(C("asset_class"), class_caps, 1.0), F.sum("f").over(Window.partitionBy(*keys, "asset_class"))
    df = df.withColumn("f", F.when(total > cap, C("f") * cap / total).otherwise(C("f")))
    total = F.sum("f").over(Window.partitionBy(*keys))
    return df.withColumn("f", F.when(total > 1, C("f") / total).otherwise(C("f")))


def stop_loss_hit(price: Column, entry: Column, atr: Column, n: float = 2.0) -> Column:
    """Inclusive: at the stop level counts."""
    return price <= entry - n * atr


def apply_veto(df: DataFrame, vetoes: DataFrame, signal: str = "signal") -> DataFrame:
    """Signals become 0 on dates with a veto; dates that the vetoes lack stay."""
    v = vetoes.filter("veto = 1").select("date", F.lit(True).alias("_v")).distinct()
    return df.join(v, "date", "left").withColumn(signal, F.when(C("_v"), F.lit(0.0)).otherwise(C(signal))).drop("_v")


def scale_by_date(f: Column, scale: Column) -> Column:
    return f * F.coalesce(scale, F.lit(1.0))


def scale_on_alert(f: Column, alert: Column, scale: float = 0.5) -> Column:
    return f if scale >= 1 else F.when(alert == 1, f * scale).otherwise(f)


def align_signals(grid: DataFrame, analyst: DataFrame, insider: DataFrame, regime: DataFrame) -> DataFrame:
    """Agent outputs on the main grid (symbol, date): a missing analyst stays null, a missing alert or veto is 0, a missing scale 1."""
    out = grid.join(analyst, ["symbol", "date"], "left").join(insider, ["symbol", "date"], "left").join(regime, "date", "left")
    return out.fillna({"alert": 0, "veto": 0, "scale": 1.0})


def combine_agents(technical: Column, meta: Column, veto: Column) -> Column:
    """The meta-model's probability where there is one, else the technical one under the veto."""
    return F.coalesce(meta, F.when(veto == 1, F.lit(0.0)).otherwise(technical))


def defensive_rotation(df: DataFrame, defensives: Sequence[str], trigger: float = 0.25, exposure: float = 0.30, keys: Sequence[str] = ("date",)) -> DataFrame:
    """On crisis dates (veto, or a scale at the trigger or below) equities go to 0 and the named defensives share `exposure`, within their caps."""
    crisis = (F.coalesce("veto", F.lit(0)) == 1) | (F.coalesce("scale", F.lit(1.0)) <= trigger + 1e-9)
    share = exposure / max(len(defensives), 1)
    moved = F.when(C("symbol").isin(*defensives), F.lit(share)).when(C("asset_class") == "equity", F.lit(0.0)).otherwise(C("f"))
    turned = normalize_by_class(df.filter(crisis).withColumn("f", moved), keys)
    return turned.unionByName(df.filter(~crisis))


def agent_votes(technical: Column, analyst: Column, alert: Column, veto: Column, scale: Column, rho: Column, base: float = 0.5) -> Column:
    """The votes behind a row, rounded to four digits."""
    return F.struct(
        F.round(technical, 4).alias("technical"),
        F.round(analyst, 4).alias("analyst"),
        F.when(alert == 1, F.lit("alert")).otherwise(F.lit("none")).alias("insider"),
        F.when(veto == 1, F.lit(0.0)).otherwise(F.round(scale, 4)).alias("regime"),
        F.when(rho > base, F.round(rho, 4)).alias("boost"),
    )


def weak_day(signal: Column, f: Column, sell_below: float = 0.0) -> Column:
    return signal < sell_below if sell_below > 0 else f <= 0


def weak_streak(df: DataFrame, sell_below: float = 0.0, keys: Sequence[str] = ("run_id", "symbol")) -> DataFrame:
    """`streak`: weak days in a row up to each date."""
    w = Window.partitionBy(*keys).orderBy("date")
    df = df.withColumn("_weak", F.coalesce(weak_day(C("signal"), C("f_star"), sell_below), F.lit(True)))
    df = df.withColumn("_run", F.sum(F.when(C("_weak"), 0).otherwise(1)).over(w))
    streak = F.sum(F.when(C("_weak"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_run").orderBy("date"))
    return df.withColumn("streak", streak.cast("long")).drop("_weak", "_run")


def open_rule(veto: Column, held: Column, f: Column, signal: Column, min_prob: float = 0.0, least: float = MIN_FRACTION) -> Column:
    rule = (F.coalesce(veto, F.lit(0)) == 0) & ~held & (f > least)
    return rule & (signal >= min_prob) if min_prob > 0 else rule


def daily_decisions(rows: DataFrame, capital: float = 10_000.0, least: float = MIN_FRACTION, min_prob: float = 0.5, rho: float = 0.5) -> DataFrame:
    """The last row of each symbol (date, probability, b, veto, asset_class) as a decision: BUY or HOLD, its reason and size."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).filter("_r = 1").drop("_r")
    f = F.when(C("veto") == 1, F.lit(0.0)).otherwise(kelly_size(C("probability"), C("b"), C("asset_class"), F.lit(rho), least=least))
    last = last.withColumn("kelly_fraction", f)
    buy = C("kelly_fraction") > 0
    return last.select(
        "date",
        C("symbol").alias("ticker"),
        F.when(buy, F.lit("BUY")).otherwise(F.lit("HOLD")).alias("action"),
        "probability",
        "kelly_fraction",
        F.struct(C("probability").alias("p"), C("b"), F.lit(rho).alias("rho")).alias("kelly_inputs"),
        F.when(C("veto") == 1, F.lit("veto")).when(buy, F.lit("signal")).otherwise(F.lit("below_threshold")).alias("reason"),
        F.round(C("kelly_fraction") * capital, 2).alias("position_size_eur"),
    )
