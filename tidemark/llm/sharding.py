"""Jump consistent hashing (Lamping and Veach, 2014) with DataFrame expressions only.

The shard of a row depends on its key and the number of shards alone; no ring table is kept, and a further
shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

#: Fixed values of the published generator: key = key * 2862933555777941757 + 1 modulo 2**64.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF
#: Steps between two looks at whether a key has arrived.
CHUNK = 8
C_HI, C_LO = MULTIPLIER >> 32, MULTIPLIER & LOW32


def _times_c_plus_1(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * C + 1 modulo 2**64 on halves of 32 bits; 16-bit limbs keep every product below 2**63, as ANSI mode asks."""
    p0 = lo.bitwiseAND(0xFFFF) * F.lit(C_LO)
    p1 = F.shiftright(lo, 16) * F.lit(C_LO)
    low = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + F.lit(1)
    hi_c = hi.bitwiseAND(0xFFFF) * F.lit(C_LO) + F.shiftleft((F.shiftright(hi, 16) * F.lit(C_LO)).bitwiseAND(0xFFFF), 16)
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + hi_c.bitwiseAND(LOW32) + (lo * F.lit(C_HI)).bitwiseAND(LOW32)
    return high.bitwiseAND(LOW32), low.bitwiseAND(LOW32)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a long key (null: key 0).

    Each step moves forward by one shard at least, so `shards` steps are enough, but about the logarithm of `shards` are taken: steps go in
    runs of CHUNK, and a key that has arrived leaves the other runs out.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(LOW32).alias("lo"),
        F.lit(0).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _times_c_plus_1(s["hi"], s["lo"])
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), jump.cast("long").alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    run = F.sequence(F.lit(1), F.lit(min(shards, CHUNK)))
    chunk = lambda s, _: F.when(s["j"] < F.lit(shards), F.aggregate(run, s, step)).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(-(-shards // CHUNK))), start, chunk, lambda s: s["b"].cast("int"))


def shard_table(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, buckets: int = 1021) -> DataFrame:
    """Shard, slot and size of every row of `df`.

    Slots count from 0 without gaps in each shard, ordered by (bucket, key, size, checksum), a bucket being the key plus the
    text's checksum modulo `buckets`, so that ids with a pattern and ids that repeat spread alike. They come
    from two levels: a count per (shard, bucket), summed up over at most shards * buckets rows, which is small enough to
    broadcast, plus a row number inside the bucket. No task sees a whole shard; choose a prime `buckets` near rows / 10**6.

    Null keys count as key 0, null texts have size 1 and checksum 0, repeated rows get a slot each, an empty table
    gives no rows, and other columns of `df` are left out. Returns the key, size, text_crc32, law, shard, slot, grown_shard.
    """
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0).cast("long")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    )
    rows = rows.withColumn("_bucket", F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 31)) + F.col("text_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["shard", "_bucket"])
        .select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_rank")).alias("slot"), "grown_shard")
    )


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
      FROM documents, tbl),
j(doc_id, n, k, b, j) AS (
  SELECT doc_id, n, (doc_id::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT doc_id, n, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (((k // 4294967296) * 2862933555777941757 % 4294967296) * 4294967296 + (k % 4294967296) * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (n = 8)::INTEGER AS shard, max(b) FILTER (n = 9)::INTEGER AS grown_shard FROM j WHERE j >= n GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (d.doc_id % 2147483648 + text_crc32) % 1021, d.doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN s ON s.doc_id = d.doc_id
"""
