"""Equity curves: two baselines in closed form, the shared-cash replay as a keyed fold, books and their valuation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import by_symbol, ratio
from ..sources.io import landed
from .asof import asof_backward
from .features import sma

C = F.col


def filled_sum(rows: DataFrame, value: str, days: DataFrame) -> DataFrame:
    """(date, total): the sum over symbols of each one's last `value` at or before the date, without a row for every symbol and date.

    A symbol moves the sum by what its value changed, so changes add up by date and then run over the dates, which are
    thousands. Rows are (symbol, date, value), values not null.
    """
    change = F.col(value) - F.coalesce(F.lag(value).over(by_symbol()), F.lit(0.0))
    by_date = rows.select("date", change.alias("_d")).groupBy("date").agg(F.sum("_d").alias("_d"))
    running = F.sum(F.coalesce("_d", F.lit(0.0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(by_date, "date", "left").select("date", running.alias("total"))


def buy_and_hold(bars: DataFrame, capital: float = 10_000.0, commission: float = 0.0008) -> DataFrame:
    """(date, equity): equal shares of the capital in every symbol at its close on the first date, less commission.

    A symbol without a valid price that day stays cash; gaps hold the last price. Slice the bars to a half-open range before.
    """
    bars = landed(bars.select("symbol", "date", "close"), "held")  # read several times below
    days = bars.select("date").distinct()
    first_day = F.broadcast(bars.agg(F.min("date").alias("_start")))  # one row
    firsts = bars.groupBy("symbol").agg(F.min_by("close", "date").alias("_first"), F.min("date").alias("_from")).join(first_day, how="cross")
    firsts = firsts.select("symbol", F.when((C("_from") == C("_start")) & (C("_first") > 0), C("_first")).alias("_first"))
    count = F.broadcast(firsts.agg(F.count(F.lit(1)).alias("_n"), F.count("_first").alias("_in")))
    held = bars.filter("close is not null").join(firsts.filter("_first is not null"), "symbol").select("symbol", "date", ((1 - commission) * C("close") / C("_first")).alias("g"))
    grown = (C("total") + C("_n") - C("_in")) / C("_n")
    return filled_sum(held, "g", days).join(count, how="cross").select("date", (grown * capital).alias("equity"))


def sma_sleeves(bars: DataFrame, fast: int = 20, slow: int = 50, capital: float = 1.0, commission: float = 0.0008) -> DataFrame:
    """(symbol, date, equity, flipped): each symbol's sleeve, in its own capital.

    In the market while the fast mean is above the slow one. The day loop has a closed form: a product over days of the
    price change while held and of the commission at each change of position, as a running sum of logarithms.
    """
    rows = bars.filter(C("close") > 0).withColumn("pos", F.coalesce((sma(C("close"), fast) > sma(C("close"), slow)).cast("int"), F.lit(0)))
    w = by_symbol()
    held = F.coalesce(F.lag("pos").over(w), F.lit(0))
    rows = rows.withColumns({"_held": held, "_move": F.coalesce(ratio(C("close"), F.lag("close").over(w)), F.lit(1.0))})
    rows = rows.withColumn("flipped", (C("pos") != C("_held")).cast("int"))
    step = F.when(C("_held") == 1, F.ln("_move")).otherwise(F.lit(0.0)) + F.when(C("flipped") == 1, F.ln(F.lit(1 - commission))).otherwise(F.lit(0.0))
    equity = F.exp(F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))) * capital
    return rows.select("symbol", "date", equity.alias("equity"), "flipped")


def sma_crossover(bars: DataFrame, fast: int = 20, slow: int = 50, capital: float = 10_000.0, commission: float = 0.0008, start: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(date, equity) of all sleeves together, which compound from the first bar and are cut to `start` afterwards, and the number of trades."""
    count = F.broadcast(bars.agg(F.countDistinct("symbol").alias("_n")))  # one row
    sleeves = sma_sleeves(bars, fast, slow, 1.0, commission)
    curve = filled_sum(sleeves, "equity", sleeves.select("date").distinct()).join(count, how="cross").select("date", (C("total") * capital / F.greatest("_n", F.lit(1))).alias("equity"))
    keep = F.lit(True) if start is None else C("date") >= F.lit(start)
    return curve.filter(keep), sleeves.filter(keep).agg(F.sum("flipped").cast("long").alias("n_trades"))


@dataclass(frozen=True)
class ReplayRules:
    capital: float = 10_000.0
    commission: float = 0.0008
    max_position: float = 0.15
    min_fraction: float = 0.01
    min_prob: float = 0.0
    sell_below: float = 0.0
    hysteresis: int = 1
    stop_atr: float = 2.0
    rebalance_every: int = 1
    close_at_end: bool = False


REPLAY_SCHEMA = "run_id string, date date, kind string, symbol string, action string, price double, shares double, capital double, commission double, kelly_fraction double, reason string, equity double"


class _Account:
    """The state of one run while its days go by."""

    def __init__(self, rules: ReplayRules):
        self.rules, self.cash = rules, rules.capital
        self.marked = rules.capital  # the value at the last day's end
        self.held: dict[str, tuple[float, float]] = {}  # shares, entry price
        self.weak: dict[str, int] = {}

    def worth(self, prices: dict[str, float]) -> float:
        return self.cash + sum(n * prices.get(s, entry) for s, (n, entry) in self.held.items())

    def sell(self, symbol: str, price: float, reason: str) -> tuple:
        shares, _ = self.held.pop(symbol)
        fee = shares * price * self.rules.commission
        self.cash += shares * price - fee
        return symbol, "SELL", price, shares, self.cash, fee, 0.0, reason

    def buy(self, symbol: str, price: float, f: float, prices: dict[str, float]) -> tuple | None:
        if self.cash <= 0:
            return None
        f = min(f, self.rules.max_position)
        spent = min(self.worth(prices) * f, self.cash)
        if spent <= 0:
            return None
        fee = spent * self.rules.commission
        shares = (spent - fee) / price
        self.cash -= spent
        self.held[symbol] = (shares, price)
        return symbol, "BUY", price, shares, self.cash, fee, f, "signal"

    def stops(self, prices: dict[str, float], atr: dict[str, float]) -> Iterator[tuple]:
        for s in [s for s in self.held if s in prices and atr.get(s) is not None]:
            entry = self.held[s][1]
            if prices[s] / entry - 1 < -self.rules.stop_atr * atr[s] / entry:
                yield self.sell(s, prices[s], "stop_loss")

    def orders(self, rows: list[tuple[str, float, float, float]], vetoed: bool, prices: dict[str, float]) -> Iterator[tuple]:
        r = self.rules
        for symbol, price, signal, f in rows:
            if symbol in self.held:
                weak = signal < r.sell_below if r.sell_below > 0 else f <= 0
                self.weak[symbol] = self.weak.get(symbol, 0) + 1 if weak else 0
                if weak and self.weak[symbol] >= r.hysteresis:
                    yield self.sell(symbol, price, "signal")
                continue
            self.weak.pop(symbol, None)
            if not vetoed and f > r.min_fraction and not (r.min_prob > 0 and signal < r.min_prob):
                if done := self.buy(symbol, price, f, prices):
                    yield done


def _replayed_day(account: _Account, place: int, day: pa.Table) -> list[tuple]:
    """A day's trades. Only rows of held symbols and of those that may be bought are looked at one by one."""
    rules, names = account.rules, day.column("symbol").to_pylist()
    price, atr, signal, f = (day.column(c).to_numpy() for c in ("price", "atr", "signal", "f_star"))
    known, f = price == price, np.where(np.isnan(f), 0.0, f)
    signal = np.where(np.isnan(signal), f, signal)
    at = {s: i for s, i in zip(names, range(len(names)), strict=True) if s in account.held}
    prices = {s: float(price[i]) for s, i in at.items() if known[i]}
    trades = list(account.stops(prices, {s: float(atr[i]) for s, i in at.items() if atr[i] == atr[i]}))
    if known.any() and (rules.rebalance_every <= 1 or place % rules.rebalance_every == 0):
        vetoed = bool((day.column("veto").to_numpy() == 1).any())
        looked = (f > rules.min_fraction) & (signal >= rules.min_prob if rules.min_prob > 0 else True) & (not vetoed)
        looked[[i for s, i in at.items() if s in account.held]] = True
        rows = np.flatnonzero(looked & known)
        columns = (c[rows].tolist() for c in (price, signal, f))
        trades += account.orders(list(zip([names[i] for i in rows], *columns, strict=True)), vetoed, prices)
    account.marked = account.worth(prices)
    return trades


def _replay(rules: ReplayRules):
    kinds = [(c.split()[0], {"date": pa.date32(), "string": pa.string()}.get(c.split()[1], pa.float64())) for c in REPLAY_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        account, run_id, date, place = None, None, None, 0
        prices: dict[str, float] = {}
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def day_ended() -> None:
            nonlocal place, prices
            day = pa.Table.from_batches(held)
            trades = _replayed_day(account, place, day)
            out.extend((run_id, date, "trade", *t, None) for t in trades)
            out.append((run_id, date, "equity", None, None, None, None, account.cash, None, None, None, account.marked))
            place += 1
            if rules.close_at_end:
                prices = {s: p for s, p in zip(day.column("symbol").to_pylist(), day.column("price").to_pylist(), strict=True) if s in account.held and p is not None and p == p}

        def run_ended() -> None:
            if rules.close_at_end:
                out.extend((run_id, date, "trade", *account.sell(s, prices.get(s, account.held[s][1]), "end_of_period"), None) for s in list(account.held))

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.dictionary_encode(batch.column("run_id"), null_encoding="encode").indices.to_numpy()
            days = batch.column("date").cast(pa.int32()).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (days[1:] != days[:-1])]))
            for begin, end in zip(starts, [*starts[1:], len(days)], strict=True):
                now = batch.column("run_id")[begin].as_py(), batch.column("date")[begin].as_py()
                if account is None or now != (run_id, date):
                    if account is not None:
                        day_ended()
                    if account is None or now[0] != run_id:
                        if account is not None:
                            run_ended()
                        account, place = _Account(rules), 0
                    (run_id, date), held = now, []
                held.append(batch.slice(begin, end - begin))
            yield told()
            out.clear()
        if account is not None:
            day_ended()
            run_ended()
            yield told()

    return run


def portfolio_replay(signals: DataFrame, rules: ReplayRules = ReplayRules()) -> DataFrame:
    """Trades and daily equity of every run, from (run_id, symbol, symbol_rank, date, price, signal, f_star, veto, atr).

    Each day: stops first (a strict loss beyond stop_atr * atr), then, on rebalance days, symbols in order of rank: a held one is sold
    after `hysteresis` weak days in a row, another is bought with at most the cash left. A missing f counts as 0, a missing
    signal as f; a symbol without a price that day is passed over. (run_id, date, symbol) is a key. Days depend on each other, runs don't: runs are the
    parallel unit, and a run's days pass through a task one by one, so no more than a day is held.
    """
    numbers = [C(c).cast("double").alias(c) for c in ("price", "signal", "f_star", "atr")]
    rows = signals.select(C("run_id").cast("string").alias("run_id"), C("symbol").cast("string").alias("symbol"), "symbol_rank", C("date").cast("date").alias("date"), C("veto").cast("double").alias("veto"), *numbers)
    rows = rows.filter("date is not null").repartition("run_id").sortWithinPartitions("run_id", "date", C("symbol_rank").asc_nulls_last(), "symbol")
    return rows.mapInArrow(_replay(rules), REPLAY_SCHEMA)


def close_stats(replayed: DataFrame) -> DataFrame:
    """What closing all positions at a run's end did: how many, fees, value before, cash after."""
    closed = C("reason") == "end_of_period"
    return replayed.groupBy("run_id").agg(
        F.count_if(closed).alias("n_positions_closed"),
        F.round(F.coalesce(F.sum(F.when(closed, C("commission"))), F.lit(0.0)), 2).alias("commission_closing"),
        F.round(F.max_by(F.when(C("kind") == "equity", C("equity")), F.when(C("kind") == "equity", C("date"))), 2).alias("portfolio_value_before"),
        F.round(F.max_by("capital", F.struct("date", closed, F.when(closed, C("capital")))), 2).alias("capital_after_close"),
    )


def mark_to_market(positions: DataFrame, cash: DataFrame, bars: DataFrame) -> DataFrame:
    """(account, date, value): positions (account, date, symbol, entry_date, quantity, allocated) valued as of each date, plus cash.

    A position is worth what was put in times close over entry close; else quantity times close; else what was put in.
    """
    now = asof_backward(positions, bars, ["symbol"], "date", "close", "close_now")
    start = bars.select("symbol", C("date").alias("entry_date"), "close")
    both = asof_backward(now, start, ["symbol"], "entry_date", "close", "close_entry")
    value = F.coalesce(C("allocated") * ratio(C("close_now"), C("close_entry")), C("quantity") * C("close_now"), C("allocated"))
    held = both.groupBy("account", "date").agg(F.sum(value).alias("_held"))
    return cash.join(held, ["account", "date"], "left").select("account", "date", (F.greatest(C("cash"), F.lit(0.0)) + F.coalesce("_held", F.lit(0.0))).alias("value"))


def apply_to_book(cash: float, book: dict[str, float], rows: list[tuple[str, str, float]]) -> tuple[float, dict[str, float], list[tuple[str, str, float]]]:
    """One account's day: (symbol, action, amount) in order. A BUY counts if the symbol isn't held, up to the cash left; a SELL gives back what was put in."""
    done = []
    for symbol, action, amount in rows:
        if action == "BUY" and symbol not in book:
            spent = round(min(amount, cash), 2)
            if spent > 0:
                cash, book[symbol] = round(cash - spent, 2), spent
                done.append((symbol, action, spent))
        elif action == "SELL" and symbol in book:
            back = book.pop(symbol)
            cash = round(cash + back, 2)
            done.append((symbol, action, back))
    return cash, book, done


BOOK_SCHEMA = "account string, date date, cash double, invested double, n_positions int, positions map<string,double>"


def replay_book(decisions: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """The book of every account after each of its days, from (account, date, seq, symbol, action, amount). A fold per account."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, book, out = capital, {}, []
        for date, day in pdf.sort_values(["date", "seq"]).groupby("date", sort=True):
            cash, book, _ = apply_to_book(cash, book, list(zip(day["symbol"], day["action"], day["amount"], strict=True)))
            out.append((pdf["account"].iloc[0], date, cash, round(sum(book.values()), 2), len(book), dict(book)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in BOOK_SCHEMA.split(", ")])

    return decisions.groupBy("account").applyInPandas(run, BOOK_SCHEMA)


def book_state(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """One row per account: its positions as a map, what is invested, cash, and the total."""
    held = positions.groupBy("account").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "allocated")))).alias("positions"), F.sum("allocated").alias("_sum"), F.count(F.lit(1)).alias("n_positions"))
    return cash.join(held, "account", "left").select("account", "positions", F.coalesce("n_positions", F.lit(0)).cast("long").alias("n_positions"), F.round(F.coalesce("_sum", F.lit(0.0)), 2).alias("invested"), F.round("cash", 2).alias("cash"), F.round(C("cash") + F.coalesce("_sum", F.lit(0.0)), 2).alias("total"))


def allocation_by_class(positions: DataFrame, cash: DataFrame) -> DataFrame:
    """Value by asset class, and Cash, per account; only positive ones."""
    parts = positions.select("account", "asset_class", C("allocated").alias("value")).unionByName(cash.select("account", F.lit("Cash").alias("asset_class"), C("cash").alias("value")))
    return parts.groupBy("account", "asset_class").agg(F.round(F.sum("value"), 2).alias("value")).filter("value > 0")


def rebase_100(curves: DataFrame, key: str = "run_id") -> DataFrame:
    first = F.first("equity", ignorenulls=True).over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return curves.withColumn("equity", F.coalesce(ratio(C("equity"), first) * 100, C("equity")))


def chain_segments(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """`a`, then `b` scaled to go on from a's last value; on dates in both, a's row."""
    ends = a.filter("equity is not null").groupBy(key).agg(F.max_by("equity", "date").alias("_end"))
    starts = b.filter("equity is not null").groupBy(key).agg(F.min_by("equity", "date").alias("_start"))
    scaled = b.join(ends, key, "left").join(starts, key, "left").withColumn("equity", F.coalesce(C("equity") * ratio(C("_end"), C("_start")), C("equity"))).select(key, "date", "equity")
    both = a.select(key, "date", "equity", F.lit(0).alias("_seq")).unionByName(scaled.withColumn("_seq", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key, "date").orderBy("_seq"))).filter("_r = 1").drop("_r", "_seq")


def compound(ret: Column, capital: float = 1.0, key: str = "run_id") -> Column:
    """The running product of 1 + ret."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log1p(ret)).over(w)) * capital


def unified_curve(strategy: DataFrame, baselines: dict[str, DataFrame], holdout_start: dt.date, paper_start: dt.date) -> DataFrame:
    """The strategy's dates with each baseline as of the date, all rebased to 100, and the period."""
    from .quality import tag_period

    out = rebase_100(strategy.withColumn("run_id", F.lit("s"))).select("run_id", "date", C("equity").alias("portfolio_value"))
    for name, curve in baselines.items():
        out = asof_backward(out, curve.withColumn("run_id", F.lit("s")), ["run_id"], "date", "equity", "_b")
        first = F.first("_b", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn(name, ratio(C("_b"), first) * 100).drop("_b")
    return out.withColumn("period", tag_period(C("date"), holdout_start, paper_start)).drop("run_id")
