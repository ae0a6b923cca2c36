"""Connected components of a link table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, let_go


#: Rows of one key that a task may get at least, and keys with more than that which are told to every task at most.
HOT_ROWS, HOT_KEYS = 512, 100_000


def hot_keys(counted: DataFrame, key: str) -> tuple[int, DataFrame | None]:
    """The rows of a written table, and (key, _parts) of the keys with more than a threshold of them; None if there are none.

    The threshold is HOT_ROWS or the HOT_KEYS-th part of all, so there are at most HOT_KEYS such keys, whatever the input.
    """
    counts = counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, top = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    most = max(HOT_ROWS, total // HOT_KEYS)
    return total, cut(counts.filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).alias("_parts"))) if top > most else None


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left.join(right, key, how), where some keys have very many rows on the left and one or a few on the right.

    A hot key is dealt into its parts by a hash of the left's row, and its rows on the right are copied to each; there are at most HOT_KEYS copies or
    so. Other keys are joined as they are.
    """
    if hot is None:
        return left.join(right, key, how)
    salt = F.coalesce(F.pmod(F.xxhash64(*[c for c, t in left.dtypes if t in ("bigint", "int")]), "_parts"), F.lit(0))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links `a`, `b` reach, for every node with a link.

    In each round a node points to the least of itself and its neighbours, by id and by hash in turn: by id a star
    shrinks to one node at once, by hash a chain of rising ids shrinks as fast as others. Links are rewritten to what their
    ends point to, and links inside a node vanish. The number of rounds is about the logarithm of the longest chain. All steps are grouped
    minima with map-side combine and equi-joins that Spark can split where one node has very many links.
    """
    pairs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    edges = cut(pairs.union(pairs.select("v", "u")).distinct())
    roots = edges.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    step = 0
    while not edges.isEmpty():
        order = F.xxhash64(F.col("v"), F.lit(step)) if step % 2 else F.col("v")
        own = F.xxhash64(F.col("u"), F.lit(step)) if step % 2 else F.col("u")
        nearest = edges.groupBy("u").agg(F.min(F.struct(order.alias("h"), F.col("v").alias("id"))).alias("m")).select("u", F.least(F.col("m"), F.struct(own.alias("h"), F.col("u").alias("id")))["id"].alias("p"))
        roots = cut(roots.join(nearest.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        moved = edges.join(nearest, "u").select(F.col("p").alias("pu"), "v").join(nearest.withColumnRenamed("u", "v"), "v").select(F.col("pu").alias("u"), F.col("p").alias("v"))
        edges = cut(moved.filter("u <> v").distinct())
        step += 1
        let_go(edges.sparkSession)
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
