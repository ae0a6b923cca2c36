"""Per-symbol indicators. Each uses the bars up to its own date; one shuffle by symbol serves all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_symbol, guarded, ratio
from .scans import Ewm, ewm, followed  # noqa: F401  ewm is part of this module's surface

C = F.col


def returns(n: int = 1, close: str = "close") -> Column:
    """Change against the n-th bar before; null without one or from a close of 0."""
    return ratio(C(close), F.lag(close, n).over(by_symbol())) - 1


def sma(col: Column, n: int) -> Column:
    return guarded(F.avg, col, n)


def close_norm(n: int = 20) -> Column:
    return ratio(C("close"), sma(C("close"), n))


def sma_ratio(fast: int, slow: int) -> Column:
    return ratio(sma(C("close"), fast), sma(C("close"), slow))


def bands(mid: Column, dev: Column, k: float = 2.0) -> dict[str, Column]:
    upper, lower = mid + k * dev, mid - k * dev
    return {"bb_upper": upper, "bb_middle": mid, "bb_lower": lower, "bb_bandwidth": ratio(upper - lower, mid), "bb_pct_b": ratio(C("close") - lower, upper - lower)}


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    return bands(sma(C("close"), n), guarded(F.stddev_samp, C("close"), n), k)


def mean_of(source: str, n: int) -> str:
    """The column in which `rolled` puts a mean."""
    return f"_mean_{source}_{n}"


def dev_of(source: str, n: int) -> str:
    return f"_dev_{source}_{n}"


#: The most rows before its own that a step of `rolled` takes together.
_STEP = 10


def _steps(n: int) -> tuple[int, ...] | None:
    """Factors of a window, the largest prime first, each small; None if it has none such."""
    primes, f = [], 2
    while n > 1:
        while n % f == 0:
            primes.append(f)
            n //= f
        f += 1
    out: list[int] = []
    for p in reversed(primes):
        if p > _STEP:
            return None
        if len(out) > 1 and out[-1] * p <= _STEP:
            out[-1] *= p
        else:
            out.append(p)
    return tuple(out)


def rolled(bars: DataFrame, means: Sequence[tuple[str, int]], devs: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Rows with the means and sample deviations of (column, window), under `mean_of` and `dev_of`; null until a window is full of values.

    The windows of a symbol grow together: sums of 5 rows from single ones, of 20 and 50 from those of 5, of 200 from those of 50, so a row takes some lags instead of a window's rows. Squares are
    kept around the means of their parts, nothing is ever taken off, and a window that stands still has deviation 0.
    """
    known = set(bars.columns)
    rows = bars
    chains = {(c, n): _steps(n) for c, n in [*means, *devs]}
    spread = {(c, chains[c, n][:k]) for c, n in devs if chains[c, n] for k in range(len(chains[c, n]) + 1)}
    name = lambda kind, c, chain: f"_{kind}_{c}_{'_'.join(map(str, chain))}"
    rows = rows.withColumns({name("sum", c, ()): C(c).cast("double") for c, _ in chains} | {name(k, c, ()): F.lit(0.0) if k == "sq" else C(c).cast("double") for c, chain in spread if not chain for k in ("sq", "hi", "lo")})
    for depth in range(max((len(x) for x in chains.values() if x), default=0)):
        grown = sorted({(c, x[: depth + 1]) for (c, _), x in chains.items() if x and len(x) > depth})
        past, sums, squares = {}, {}, {}
        for c, chain in grown:
            size = 1
            for f in chain[:-1]:
                size *= f
            kinds = ("sum", "sq", "hi", "lo") if (c, chain) in spread else ("sum",)
            parts = {k: [name(k, c, chain[:-1]), *(f"{name(k, c, chain[:-1])}_at{i * size}" for i in range(1, chain[-1]))] for k in kinds}
            past |= {parts[k][i]: F.lag(parts[k][0], i * size).over(by_symbol()) for k in kinds for i in range(1, chain[-1])}
            total = sum((C(p) for p in parts["sum"][1:]), C(parts["sum"][0]))
            sums[name("sum", c, chain)] = total
            if len(kinds) > 1:
                whole = C(name("sum", c, chain)) / (size * chain[-1])
                off = [C(q) + size * F.pow(C(p) / size - whole, 2) for p, q in zip(parts["sum"], parts["sq"], strict=True)]
                squares |= {name("sq", c, chain): sum(off[1:], off[0])}
                sums |= {name("hi", c, chain): F.greatest(*parts["hi"]), name("lo", c, chain): F.least(*parts["lo"])}
        rows = rows.withColumns(past).withColumns(sums).withColumns(squares).drop(*past)
    out = {mean_of(c, n): C(name("sum", c, chains[c, n])) / n if chains[c, n] is not None else sma(C(c), n) for c, n in means}
    for c, n in devs:
        x = chains[c, n]
        still = C(name("hi", c, x)) == C(name("lo", c, x)) if x else None
        there = C(name("sum", c, x)).isNotNull() & F.lit(n > 1) if x is not None else None
        out[dev_of(c, n)] = F.when(there, F.when(still, F.lit(0.0)).otherwise(F.sqrt(C(name("sq", c, x)) / (n - 1)))) if x else guarded(F.stddev_samp, C(c), n)
    rows = rows.withColumns(out)
    return rows.drop(*[c for c in rows.columns if c not in known and c not in out])


def volume_ratio(n: int = 20) -> Column:
    return ratio(C("volume"), sma(C("volume"), n))


def true_range() -> Column:
    before = F.lag("close").over(by_symbol())
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


def target() -> tuple[Column, Column]:
    """The next bar's return, and 1.0 or 0.0 for its sign; null on the last bar."""
    r = ratio(F.lead("close", 1).over(by_symbol()), C("close")) - 1
    return r, F.when(r.isNotNull(), (r > 0).cast("double"))



def _rsi(w: int) -> Column:
    rs = ratio(C(f"_gain_{w}"), C(f"_loss_{w}"))
    return 100 - 100 / (1 + rs)


def compute_all_features(
    bars: DataFrame,
    close_norm_window: int = 20,
    rsi_window: int = 14,
    rsi_window_long: int = 28,
    macd_windows: tuple[int, int, int] = (12, 26, 9),
    bollinger_window: int = 20,
    atr_window: int = 14,
    volume_window: int = 20,
    sma_windows: tuple[int, int] = (20, 50),
    sma_long_windows: tuple[int, int] = (50, 200),
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Bars (symbol, date, open, high, low, close, volume) with every indicator (or those that are `wanted`) and the two targets.

    A symbol's rows come together once; windows and recursive means take them in that order.
    """
    own = bars.columns
    df = rolled(bars.repartition("symbol"), [*dict.fromkeys(("close", n) for n in (close_norm_window, bollinger_window, *sma_windows, *sma_long_windows)), ("volume", volume_window)], [("close", bollinger_window)])
    change = C("close") - F.lag("close").over(by_symbol())
    df = df.withColumns({"_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), "_tr": true_range()})
    fast, slow, signal = macd_windows
    specs = [Ewm("close", "_fast", 2 / (fast + 1), False), Ewm("close", "_slow", 2 / (slow + 1), False), Ewm("_tr", "atr", 1 / atr_window, True, atr_window)]
    for w in dict.fromkeys((rsi_window, rsi_window_long)):
        specs += [Ewm("_gain", f"_gain_{w}", 1 / w, True, w), Ewm("_loss", f"_loss_{w}", 1 / w, True, w)]
    specs.append(Ewm("_fast", "macd_signal", 2 / (signal + 1), False, less="_slow"))
    ret, up = target()
    mean = lambda c, n: C(mean_of(c, n))
    plain = {
        "close_norm": ratio(C("close"), mean("close", close_norm_window)),
        **{f"return_{n}d": returns(n) for n in (1, 5, 20)},
        **bands(mean("close", bollinger_window), C(dev_of("close", bollinger_window))),
        "volume_ratio": ratio(C("volume"), mean("volume", volume_window)),
        "sma_20_50_ratio": ratio(mean("close", sma_windows[0]), mean("close", sma_windows[1])),
        "sma_50_200_ratio": ratio(mean("close", sma_long_windows[0]), mean("close", sma_long_windows[1])),
        "target_return_1d": ret,
        "target_binary": up,
    }
    later = {"atr": C("atr"), "macd": C("_fast") - C("_slow"), "macd_signal": C("macd_signal"), "rsi_14": _rsi(rsi_window), "rsi_28": _rsi(rsi_window_long), "macd_hist": C("_fast") - C("_slow") - C("macd_signal"), "atr_pct": ratio(C("atr"), C("close"))}
    asked = lambda c: wanted is None or c in wanted
    df = df.withColumns({c: v for c, v in plain.items() if asked(c)})
    df = df.select(*own, *filter(asked, plain), "_gain", "_loss", "_tr").sortWithinPartitions("symbol", "date")  # the order in which windows leave them
    return followed(df, specs, "symbol").select(*own, *filter(asked, plain), *[v.alias(c) for c, v in later.items() if asked(c)])


#: Inputs of the technical classifier, under the names that stored models and configurations use.
MODEL_FEATURES = [
    "close_norm", "return_1d", "return_5d", "return_20d", "rsi_14", "rsi_28", "macd", "macd_signal", "macd_hist",
    "bb_bandwidth", "bb_pct_b", "atr_pct", "volume_ratio", "sma_20_50_ratio", "sma_50_200_ratio",
]
