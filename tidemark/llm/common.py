"""Shared pieces: reading a table, cutting lineage, a few text expressions."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Spark's setting for the bytes of an Arrow batch, and its default.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on any file system Spark reads."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB for the Python tasks of this session, unless it has set a size of its own: by default a batch may take 64 MB, several times over in a task."""
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it; a local one only where none is configured and everything runs in this process (tests)."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return f"file://{shared.removeprefix('file:')}" if shared.startswith(("/", "file:/")) and "://" not in shared else shared


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the reliable checkpoint folder and go on from there, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a compressed table below the shared folder, read back: `cut` for what is large, since checkpoints are not compressed. The table stays until the folder goes."""
    bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Free what no frame refers to any more, between rounds of many small jobs: Spark drops shuffle files, checkpoints and their plans only when the driver collects its memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null, empty or blank texts."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


# ---- inside tasks


def slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices whose texts or binaries in `column` take `size` bytes at most (one row may take more).

    When they end, the memory that the task freed goes back to the machine, as Python workers outlive their tasks.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")) - at)
            yield batch.slice(at, n)
            at += n
        del batch
    give_back()


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if name := ctypes.util.find_library("c"):
        trim = getattr(ctypes.CDLL(name), "malloc_trim", None)  # GNU only
        if trim is not None:
            trim(0)


class Memo:
    """Values of keys met lately, within a number of bytes: a full generation becomes the old one, and what is used again moves on.

    `turn(keys)` brings the keys that are known into `new`; `update` adds others. Both generations stay within `size` bytes
    together, but for the keys of one turn. `entry` is what a key and its value take beside their lengths, with the dictionary's share.
    """

    def __init__(self, size: int, entry: int = 180):
        self.bound, self.entry, self.held, self.new, self.old = size // 2, entry, 0, {}, {}

    def turn(self, keys: Iterable) -> None:
        if self.held > self.bound:
            self.old, self.new, self.held = self.new, {}, 0
        self.recall(keys)

    def recall(self, keys: Iterable) -> None:
        if self.old:
            old, new = self.old, self.new
            known = [k for k in keys if k in old and k not in new]
            self.update(known, [old[k] for k in known])

    def update(self, keys: list, values: list) -> None:
        self.new.update(zip(keys, values, strict=True))
        sized = values and isinstance(values[0], (bytes, str))
        self.held += self.entry * len(keys) + sum(map(len, keys)) + (sum(map(len, values)) if sized else 0)
