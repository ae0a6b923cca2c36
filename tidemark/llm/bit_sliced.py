"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to integers and dealt into blocks of bounded size. A block keeps, for each dimension, one bitmap
over its rows per bit of the value; these slices are built once and written. A query's scores in a block are a bit-sliced sum: each
dimension's slices, shifted by the bits of the query's weight, are added with carry-save adders on whole bitmaps; a negative weight takes the
complement. The best rows are then found from the most significant slice downward; rows tied at the boundary are
taken by id. Queries meet all rows: a task reads a batch of queries and then its blocks of the index one after the other, and keeps each
query's best rows so far, so what is shuffled is the rows, their slices, the queries for each task and the tasks' answers.

Integers are exact at any size. Rows whose numbers could make a score leave 64 bits are dealt into small blocks of their own, and they and
queries like them are worked with Python's integers.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, read_table

#: Rows in a block at most, on average; of vectors with large numbers; queries in a batch, on average; tasks for each core.
BLOCK_ROWS, WIDE_ROWS, BATCH_QUERIES, TASKS, SCALE = 8192, 128, 65_536, 2, 64
#: Sums of absolute quantised components up to which scores of two vectors fit into 64 bits.
NARROW = 1 << 30
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", carry: Sequence[str] = ()) -> DataFrame:
    """(vec_id, x) and the columns `carry`: the components as doubles, of rows with an id whose components are all finite numbers. Rows that repeat stay."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return df.select(F.col(key).cast("long").alias("vec_id"), x.alias("x"), *carry).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)


def _wide(scale: int) -> Column:
    """Whether a vector's integers are too large for scores of 64 bits."""
    return F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v)) * scale + F.size("x") >= float(NARROW)


def integers(vectors: list[np.ndarray], scale: int, wide: bool) -> np.ndarray:
    """floor(scale * component) as a matrix, 0 beyond a vector's end; Python's integers if `wide`."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), object if wide else np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = [math.floor(scale * c) if abs(c) < 2.0**52 else scale * int(c) for c in v.tolist()] if wide else np.floor(np.asarray(v) * scale)
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, bit k of the row in order."""
    short = -bits.shape[-1] % 64
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, short)])
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view("<u8")


class Slices:
    """The bit slices of a block: a bitmap over its rows per dimension and bit of the values less `low`, and its complement."""

    def __init__(self, rows: int, dims: int, low: int, up: np.ndarray):
        self.rows, self.dims, self.low, self.width = rows, dims, low, len(up)
        self.all = _packed(np.ones((1, rows), bool))[0]
        self.bitmaps = np.stack([up, self.all & ~up]).reshape(-1, len(self.all))

    @classmethod
    def of(cls, x: np.ndarray) -> Slices:
        low = int(x.min(initial=0)) if x.size else 0
        v = (x - low).T
        width = max(1, int(v.max(initial=0)).bit_length()) if x.size else 1
        up = np.stack([_packed((v >> b & 1).astype(bool)) for b in range(width)]) if x.size else np.zeros((width, 0, -(-len(x) // 64)), "<u8")
        return cls(len(x), x.shape[1], low, up)

    def stored(self) -> bytes:
        return pickle.dumps((self.rows, self.dims, self.low, self.bitmaps[: self.width * self.dims].reshape(self.width, self.dims, len(self.all))))

    def _place(self, sign: int, bit: int, dims: np.ndarray) -> np.ndarray:
        return (sign * self.width + bit) * self.dims + dims

    def sum(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Bitmaps of the scores' bits, least significant first, and what to add to a score read from them.

        Weights are taken in signed digits (no two neighbours set), which needs a third fewer slices than plain bits.
        """
        q = q[: self.dims]
        full, add = (1 << self.width) - 1, self.low * int(q.sum())
        places: dict[int, list[np.ndarray]] = {}
        k, rest = 0, q
        while rest.any():
            digit = np.where(rest & 1, 2 - (rest & 3), 0)
            rest = rest - digit >> 1
            for sign, at in enumerate((np.flatnonzero(digit > 0), np.flatnonzero(digit < 0))):
                if len(at):
                    add -= sign * full * len(at) << k
                    for b in range(self.width):
                        places.setdefault(k + b, []).append(self._place(sign, b, at))
            k += 1
        carried: dict[int, list[np.ndarray]] = {}
        out: list[np.ndarray] = []
        p = 0
        while places or carried:
            parts = carried.pop(p, [])
            if p in places:
                parts.append(self.bitmaps[np.concatenate(places.pop(p))])
            stack = (np.concatenate(parts) if len(parts) > 1 else parts[0]) if parts else np.zeros((1, len(self.all)), "<u8")
            up = carried.setdefault(p + 1, [])
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                np.bitwise_and(a, b, out=b)
                np.bitwise_and(half, c, out=a)
                up.append(np.bitwise_or(a, b))
                np.bitwise_xor(half, c, out=c)
                stack = stack[2 * n :]
            if len(stack) == 2:
                up.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            if not up:
                del carried[p + 1]
            out.append(stack[0])
            p += 1
        return out, add

    def top(self, q: np.ndarray, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """(score, row number) of the k best rows; at equal scores the smaller row numbers."""
        bits, add = self.sum(q)
        left, taken = self.all.copy(), np.zeros_like(self.all)
        if without is not None:
            left[without >> 6] &= ~np.uint64(1 << (without & 63))
        for s in reversed(bits):
            more = taken | left & s
            n = int(np.bitwise_count(more).sum())
            if n > k:
                left &= s
            else:
                taken, left = more, left & ~s
                if n == k:
                    break
        rows = _positions(taken)
        if len(rows) < k:
            rows = np.concatenate([rows, _positions(left)[: k - len(rows)]])
        narrow = len(bits) < 62 and abs(add) < 1 << 61
        scores = np.array([add] * len(rows), np.int64 if narrow else object)
        for b, s in enumerate(bits):
            hit = (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(scores.dtype)
            scores = scores + (hit << b)
        return list(zip(scores.tolist(), rows.tolist(), strict=True))


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def beyond(score: int) -> str | None:
    """None for a score of 64 bits; else a text that sorts as the scores beyond them do."""
    if LONG_MIN <= score <= LONG_MAX:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):05d}{digits}"
    return f"{99999 - len(digits):05d}{''.join(str(9 - int(d)) for d in digits)}"


def _indexed(scale: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        wide = bool(pdf["wide"].iloc[0])
        content = Slices.of(integers(pdf["x"].to_list(), scale, wide)).stored()
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "wide": [wide], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "rows": [pdf["row"].to_numpy("<i8").tobytes()], "content": [content]})

    return run


def build_index(vectors: DataFrame, blocks: int, wide_blocks: int, scale: int = SCALE) -> DataFrame:
    """(block, wide, ids, rows, content): the slices of every row of (row, vec_id, x), written once."""
    wide = _wide(scale)
    block = F.when(wide, blocks + F.pmod(F.xxhash64("row"), F.lit(wide_blocks))).otherwise(F.pmod(F.xxhash64("row"), F.lit(blocks))).cast("int")
    rows = vectors.select("row", "vec_id", "x", wide.alias("wide"), block.alias("block"))
    return cut(rows.groupBy("block").applyInPandas(_indexed(scale), "block int, wide boolean, ids binary, rows binary, content binary"))


def _searched(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, best = None, [], []

        def answers() -> pa.RecordBatch:
            rows = [(row, vec_id, at, c, score) for (row, vec_id, _), found in zip(asked, best, strict=True) for score, c, at in found]
            row, query, _, candidate, score = zip(*rows, strict=True) if rows else ((),) * 5
            clipped = [min(max(s, LONG_MIN), LONG_MAX) for s in score]
            return pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(query, pa.int64()), pa.array(candidate, pa.int64()), pa.array(clipped, pa.int64()), pa.array([beyond(s) for s in score], pa.string())],
                ["row", "query_id", "vec_id", "score", "beyond"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    if asked:
                        yield answers()
                    cell, asked, best = r["cell"], [], []
                if r["content"] is None:
                    x = np.array(r["x"], float)
                    asked.append((r["row"], r["vec_id"], integers([x], scale, bool(r["wide"]))[0]))
                    best.append([])
                    continue
                index, ids, rows = Slices(*pickle.loads(r["content"])), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["rows"], "<i8")
                at = {row: i for i, row in enumerate(rows.tolist())}
                for i, (row, _, q) in enumerate(asked):
                    found = [(-score, int(ids[j]), int(rows[j])) for score, j in index.top(q, k, at.get(row))]
                    best[i] = [(-s, c, n) for s, c, n in sorted([*((-s, c, n) for s, c, n in best[i]), *found])[:k]]
        if asked:
            yield answers()
        give_back()

    return run


def top_k(vectors: DataFrame, wanted: str, k: int = 20, scale: int = SCALE, block_rows: int = BLOCK_ROWS, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows of `vectors` for each of its rows that the condition `wanted` on vec_id takes as a query.

    `vectors` is (vec_id, x) as `quantised` makes it: rows with a null id, a null vector or a component that is null or not
    finite take no part. Each row is a candidate and, if wanted, a query of its own, ids that repeat included; a query leaves out itself only. A
    vector that is shorter than another counts as 0 beyond its end, and an empty table gives no rows. Ties go to the smaller id.
    Scores are exact and ranked as such; one that 64 bits can't hold is given as the nearest long.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("query", F.coalesce(F.expr(wanted), F.lit(False))))
    n = vectors.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("query").cast("int")), F.lit(0)).alias("queries"), F.coalesce(F.sum(_wide(scale).cast("int")), F.lit(0)).alias("wide")).first()
    groups = max(1, TASKS * spark.sparkContext.defaultParallelism)
    blocks = groups * max(1, math.ceil(n["rows"] / groups / block_rows))
    index = build_index(vectors, blocks, max(1, math.ceil(n["wide"] / WIDE_ROWS)), scale)
    parts = max(1, math.ceil(n["queries"] / batch_queries))
    cell = lambda group, part: (F.col(group) * parts + F.col(part)).cast("int").alias("cell")
    sliced = index.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    null = lambda kind: F.lit(None).cast(kind)
    sliced = sliced.select(cell("group", "part"), null("long").alias("row"), null("long").alias("vec_id"), null("array<double>").alias("x"), "wide", "ids", "rows", "content", "block")
    asked = vectors.filter("query").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.select(cell("group", "part"), "row", "vec_id", "x", _wide(scale).alias("wide"), null("binary").alias("ids"), null("binary").alias("rows"), null("binary").alias("content"), F.lit(-1).alias("block"))
    cells = asked.unionByName(sliced).repartition(groups * parts, "cell").sortWithinPartitions("cell", "block")
    found = cells.mapInArrow(_searched(k, scale), "row long, query_id long, vec_id long, score long, beyond string")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(read_table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0")


OP6_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
