"""Daily jobs as streams: files that arrived are worked through once, state is kept by Spark."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import apply_to_book
from ..sources.io import upsert

C = F.col


def session_files(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, oldest first, `files` to a micro-batch: with a file a session, a batch is a session."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", False).parquet(path)


def catch_up(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run `work` on everything that isn't processed yet, batch by batch in order, and stop; what is done stays done, an error stops the rest, and the next start goes on with the batch that failed."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---- the upsert sink: batches in folders of their own, and a manifest that names those that count

#: Folders of a batch by the hash of its keys; manifests that `sweep` keeps.
KEY_BUCKETS, KEPT_MANIFESTS = 16, 2


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, jvm


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, where, jvm = _files(spark, f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def live_batches(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest manifest's number (0 before the first) and its folders by batch."""
    found = _manifests(spark, path)
    if not found:
        return 0, {}
    text = "".join(r[0] for r in spark.read.text(f"{path}/manifest/{found[-1]:012d}.json").collect())
    return found[-1], {int(k): v for k, v in json.loads(text).items()}


def _publish(spark: SparkSession, path: str, number: int, batches: dict[int, str]) -> None:
    """Make the manifest of this number, whole or not at all; fails if another writer made it first."""
    fs, where, jvm = _files(spark, f"{path}/manifest/{number:012d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(where.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({str(k): v for k, v in sorted(batches.items())}).encode()))
    out.close()
    if fs.exists(where) or not fs.rename(draft, where):
        fs.delete(draft, False)
        raise RuntimeError(f"manifest {number} of {path} was made by another writer")


def _bucket_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")


def _written(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> str:
    """The rows in a new folder, dealt into folders by key; its name."""
    name = f"data-{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket_of(keys)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{name}")
    return name


def upsert_sink(spark: SparkSession, path: str, keys: list[str], schema: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink below `path`: each micro-batch writes its own rows, one a key, once; `read_upserted` has the last row of each key.

    A batch never reads or rewrites what others wrote. Its folder counts from the moment that a manifest names it, and manifests appear whole, so a reader sees all of a batch or
    nothing, and a batch that is retried takes its own place. One writer works at a time; a second one fails. `compact` folds batches into one now and then.
    """
    columns = [c.split()[0] for c in schema.split(", ")]

    def work(batch: DataFrame, n: int) -> None:
        none = spark.createDataFrame([], schema)
        rows = upsert(none, batch.select(*columns), keys).withColumn("batch", F.lit(n).cast("long"))
        number, live = live_batches(spark, path)
        folder = _written(spark, rows, path, keys)
        _publish(spark, path, number + 1, live | {n: folder})

    return work


def read_upserted(spark: SparkSession, path: str, keys: list[str], schema: str, upto: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of an upsert sink: of each key the one of the newest batch (up to `upto`).

    `wanted`, a small table of the key columns, asks for some keys only; then only the folders of their hashes are read.
    """
    _, live = live_batches(spark, path)
    folders = [f for n, f in live.items() if upto is None or n <= upto]
    full = f"{schema}, batch long, _bucket int"
    rows = spark.createDataFrame([], full) if not folders else reduce(DataFrame.unionByName, [spark.read.schema(full).parquet(f"{path}/{f}") for f in folders])
    if wanted is not None:
        buckets = [r[0] for r in wanted.select(_bucket_of(keys)).distinct().collect()]
        rows = rows.filter(C("_bucket").isin(buckets)).join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
    rows = rows if upto is None else rows.filter(C("batch") <= upto)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_r", newest).filter("_r = 1").drop("_r", "batch", "_bucket")


def compact(spark: SparkSession, path: str, target: str | None, keys: list[str], schema: str, upto: int) -> None:
    """Fold the batches up to `upto` into one, which takes their places in one step: readers see the batches before or the one after, never both.

    With a `target`, the table's rows go there instead, later batches as they are, and the table stays. A compaction that fails before its manifest leaves only a
    folder that nothing names; `sweep` removes it.
    """
    number, live = live_batches(spark, path)
    old = {n for n in live if n <= upto}
    home = target or path
    rows = read_upserted(spark, path, keys, schema, upto).withColumn("batch", F.lit(upto).cast("long"))
    folded = {upto: _written(spark, rows, home, keys)} if old else {}
    if target is None:
        _publish(spark, path, number + 1, {n: f for n, f in live.items() if n not in old} | folded)
        return
    later = {n: _written(spark, spark.read.parquet(f"{path}/{f}").drop("_bucket"), home, keys) for n, f in live.items() if n not in old}
    _publish(spark, home, live_batches(spark, home)[0] + 1, folded | later)


def sweep(spark: SparkSession, path: str, kept: int = KEPT_MANIFESTS) -> list[str]:
    """Remove manifests but the newest `kept`, and folders that none of these names; what was removed. Only while no batch is being written."""
    fs, where, jvm = _files(spark, path)
    numbers = _manifests(spark, path)
    named: set[str] = set()
    for n in numbers[-kept:]:
        named |= set(json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest/{n:012d}.json").collect())).values())
    gone = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named]
    gone += [jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n:012d}.json") for n in numbers[:-kept]]
    for p in gone:
        fs.delete(p, True)
    return [p.getName() for p in gone]


# ---- news


def news_by_session(news: DataFrame, sessions: DataFrame, delay: str = "3 days", close_hour: int = 16, zone: str = "America/New_York") -> DataFrame:
    """Mean score per symbol and session of a stream (symbol, created_at, score), with the static map (day, session) of operators.asof.session_map.

    News from the closing hour on goes to the next session. A session's event time is its closing instant: in output mode append its rows come, once, when the newest session seen
    closes `delay` later, then leave the state, and news of it that comes after that is dropped (and counted, see `run_sessions`). Rows without a symbol
    only move time on, as a heartbeat does.
    """
    local = F.from_utc_timestamp("created_at", zone)
    day = F.when(F.hour(local) >= close_hour, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    rows = news.withColumn("day", day).join(F.broadcast(sessions.select("day", "session")), "day")
    closes = F.to_utc_timestamp(C("session").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(close_hour)), zone)
    rows = rows.withColumn("closes_at", closes).withWatermark("closes_at", delay)
    return rows.groupBy("symbol", C("session").alias("session_date"), "closes_at").agg(F.avg("score").alias("sentiment_raw"), F.count("symbol").alias("n_news")).filter("n_news > 0").drop("closes_at")


def run_sessions(means: DataFrame, out: str, checkpoint: str) -> list[dict[str, int]]:
    """Append the sessions that have closed to the table `out`, and stop. One entry a micro-batch: `late`, rows that came too late (those of a symbol and session
    that came together count once), and `open`, rows that the state still holds."""
    query = means.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [{"late": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]), "open": sum(o["numRowsTotal"] for o in p["stateOperators"])} for p in query.recentProgress]


BOOK = "account string, date date, cash double, invested double, n_positions int"


def running_book(decisions: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """The book of each account after each of its days, from a stream of decisions (account, date, seq, symbol, action, amount); state: cash and positions."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cash, names, amounts = state.get if state.exists else (capital, [], [])
        book = dict(zip(names, amounts, strict=True))
        rows = pd.concat(list(batches)).sort_values(["date", "seq"])
        out = []
        for date, day in rows.groupby("date", sort=True):
            cash, book, _ = apply_to_book(cash, book, list(zip(day["symbol"], day["action"], day["amount"], strict=True)))
            out.append((key[0], date, cash, round(sum(book.values()), 2), len(book)))
        state.update((cash, list(book), list(book.values())))
        yield pd.DataFrame(out, columns=["account", "date", "cash", "invested", "n_positions"])

    return decisions.groupBy("account").applyInPandasWithState(step, BOOK, "cash double, names array<string>, amounts array<double>", "append", GroupStateTimeout.NoTimeout)
