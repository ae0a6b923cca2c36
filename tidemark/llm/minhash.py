"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts with equal shingle sets form a class. A class has a signature of `coords` minima; it is posted under each pair of
coordinate and value, and two classes are candidates if at least `matches` coordinates agree. That is an overlap
search, solved as such: values are ordered by how many classes share them, and two classes that agree on `matches`
coordinates must share one of the coords - matches + 1 rarest values of each (prefix), while classes with fewer shared
values than `matches` and lists whose classes are in one component already are passed over (skip). Candidates are
confirmed on full shingle sets. No list is expanded into all its pairs: a star joins most of what belongs together, and
what is left across components is settled in blocks that only give links away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, let_go, read_table, slices
from .components import connected_components, hot_keys, spread_join

#: At similarity 0.8 a pair agrees on fewer than 36 of 64 coordinates with a chance below one in 100,000.
COORDS, MATCHES = 64, 36
#: Bytes that the words kept in a task may take.
_MEMO_BYTES = 24 << 20
#: Ids up to which they are broadcast (longs, so some tens of MB); classes, and shingles of their sets, in a block on average.
BROADCAST_IDS, BLOCK, BLOCK_SHINGLES = 1_000_000, 256, 1 << 20


def _family(coords: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hash family, from a fixed seed."""
    rng = np.random.default_rng(20240229)
    draw = lambda: rng.integers(0, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        if self.held > _MEMO_BYTES:
            self.clear()
            self.held = 0
        self.held += len(word) + 180
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, words: int, memo: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `words`-word shingles of a text, A-Z in lower case."""
    found = (text or b"").lower().split()  # bytes: white space is \x20 and \x09-\x0D
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([memo[w] for w in found], np.uint64)
    prime = np.uint64(0x9E3779B97F4A7C15)
    n = max(len(h) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ (out >> np.uint64(29))) * prime + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def _sketch(words: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (mul, add) = _WordHashes(), _family(coords)
        mul, add = mul[:, None], add[:, None]
        for batch in slices(batches, 1):
            sizes, contents, sigs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                h = shingle_hashes(text.as_py(), words, memo)
                sizes.append(len(h))
                contents.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                if not len(h):
                    sigs.append(None)
                    continue
                low = np.full(coords, 2**64 - 1, np.uint64)
                for k in range(0, len(h), 1024):
                    low = np.minimum(low, (mul * h[None, k : k + 1024] + add).min(axis=1))
                sigs.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "content", "sig"])

    return run


def sketches(df: DataFrame, words: int, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, content (digest of the shingle set, null if empty) and signature of every row of (doc_id, text)."""
    return df.mapInArrow(_sketch(words, coords), "doc_id long, n_shingles long, content binary, sig array<int>")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in slices(batches, 1):
            found = [shingle_hashes(t.as_py(), words, memo).view(np.int64) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(key, id): each class under its rarest shared coordinate values, as many as no partner can avoid."""
    posted = classes.select("id", F.posexplode("sig").alias("i", "v")).select("id", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v")).alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    listed = posted.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))  # at most `coords` a class
    listed = listed.filter(F.size("keys") >= matches)
    return listed.select("id", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (matches - 1))).alias("k")).select("k.key", "id")


def _agreeing(pairs: DataFrame, classes: DataFrame, matches: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures agree on `matches` coordinates."""
    side = lambda s: classes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    sized = F.least("n_a", "n_b") >= F.lit(similarity) * F.greatest("n_a", "n_b")
    pairs = cut(pairs)  # a hub is in very many pairs
    return spread_join(pairs.join(side("a"), "a"), side("b"), "b", hot_keys(pairs, "b")[1]).filter(sized).filter(agree >= matches).select("a", "b").distinct()


def _shingle_sets(docs: DataFrame, wanted: DataFrame, n: int, words: int) -> DataFrame:
    """(id, shingles) of the wanted ids' texts, made anew. The ids are broadcast if their number `n` allows, so that texts stay where they are read."""
    wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    return texts.mapInArrow(_sets(words), "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity: 100 * intersection >= percent * union."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    n, hot = hot_keys(pairs, "b")
    sets = cut(_shingle_sets(docs, wanted, 2 * n, words))
    both = spread_join(pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b", hot)
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return both.filter(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, as products of 0/1 matrices over the values that both sides have, some columns at a time."""
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    shared = np.intersect1d(flat[0][0], flat[1][0])
    places = []
    for values, row in flat:
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], row[hit][order]))
    out = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(shared), columns):
        sides = []
        for (at, row), n in zip(places, out.shape, strict=True):
            lo, hi = np.searchsorted(at, (start, start + columns))
            m = np.zeros((n, columns), np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _linked_blocks(percent: int, matches: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = np.empty((0, 2), np.int64)
        if len(left) and len(right):
            sig_a, sig_b = np.stack(left["sig"].to_list()), np.stack(right["sig"].to_list())
            sets_a, sets_b = left["shingles"].to_list(), right["shingles"].to_list()
            n_a, n_b = np.array([len(v) for v in sets_a])[:, None], np.array([len(v) for v in sets_b])[None, :]
            agree = np.stack([(sig_b == sig).sum(axis=1) for sig in sig_a]) >= matches
            fit = agree & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            i, j = np.nonzero(fit)
            if len(i) > 4 * (len(left) + len(right)):
                common = _common(sets_a, sets_b)[i, j]
            else:
                common = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
            link = 100 * common >= percent * (n_a[i, 0] + n_b[0, j] - common)
            found = np.stack([left["id"].to_numpy()[i[link]], right["id"].to_numpy()[j[link]]], axis=1)
            del sets_a, sets_b
        give_back()
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _cross_links(listed: DataFrame, main: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, matches: int) -> DataFrame:
    """Every link between two components that a list brings together, exactly.

    Classes outside a list's largest component (minor ones) may link to any class of the list. Classes are dealt into blocks
    of about BLOCK classes, or BLOCK_SHINGLES shingles, by the component they are near; blocks that share a list, one of them minor, meet once, count
    agreeing coordinates on whole signatures and confirm on full sets. Only links leave a block, never pairs.
    """
    seen = listed.join(main.select("key", "main", "n"), "key")
    near = F.max(F.struct(F.col("n"), F.col("main"))).alias("near")
    ids = seen.groupBy("id", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("minor"), near)
    ids = ids.select("id", "comp", "minor", F.when(F.col("minor"), F.col("near.main")).otherwise(F.col("comp")).alias("g"))
    weighed = ids.join(classes.select("id", "n_shingles"), "id")
    sizes = weighed.groupBy("g", "minor").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    ids = ids.join(sizes, ["g", "minor"]).select("id", "comp", "minor", F.xxhash64("g", "minor", F.pmod(F.xxhash64("id"), "parts")).alias("block"))
    ids = cut(ids)
    spread = listed.select("key", "id").join(ids.select("id", "block", "minor"), "id").select("key", "block", "minor").distinct()
    meet = spread.filter("minor").select("key", F.col("block").alias("x")).join(spread.select("key", F.col("block").alias("y")), "key")
    meet = cut(meet.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    sets = _shingle_sets(docs, ids.select("id").distinct(), ids.count(), words)
    full = cut(ids.join(classes.select("id", "sig"), "id").join(sets, "id").select("block", "id", "comp", "sig", "shingles"))
    names = ["x", "y", "id", "comp", "sig", "shingles"]
    side = lambda s: meet.join(full.withColumnRenamed("block", s), s).select(names).toDF(*names).groupBy("x", "y")  # noqa: E731  toDF: two sides of one table need names of their own
    return side("x").cogroup(side("y")).applyInPandas(_linked_blocks(percent, matches), "a long, b long")


def similar_components(docs: DataFrame, classes: DataFrame, postings: DataFrame, words: int, percent: int, matches: int) -> DataFrame:
    """(id, component) of the classes that link to another.

    First a star: each list's classes are tested against its smallest, which costs the length of the lists and joins most
    of what belongs together. Then, if lists still hold several components, all links across them are looked for.
    """
    hubs = postings.groupBy("key").agg(F.min("id").alias("b"))
    pairs = postings.join(hubs, "key").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = cut(_confirmed(_agreeing(pairs, classes, matches, percent / 100), docs, words, percent))
    let_go(docs.sparkSession)
    found = cut(connected_components(links)).withColumnRenamed("node", "id")
    listed = postings.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    main = listed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
    main = cut(main.filter("comps > 1").select("key", F.col("m.comp").alias("main"), F.col("m.n").alias("n")))
    if main.isEmpty():
        return found
    more = cut(_cross_links(listed.join(main.select("key"), "key"), main, docs, classes, words, percent, matches))
    let_go(docs.sparkSession)
    if more.isEmpty():
        return found
    return connected_components(links.union(more)).withColumnRenamed("node", "id")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `df`.

    Texts link if 100 * intersection >= percent * union of their `words`-word shingle sets; component_id is the smallest
    doc_id that links reach. Texts without words (null, empty, blank) have no shingles and link with nothing; fewer words
    than `words` make one shingle. Rows that repeat a doc_id count as one document with all their texts, each kept as a
    row. Rows without a doc_id link with nothing and keep a null component_id (kept is true). An empty table gives no
    rows; other columns of `df` are left out.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(sketches(docs, words, coords))
    known = rows.filter("doc_id is not null and content is not null")
    classes = cut(known.groupBy("content").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m")).select("content", F.col("m.doc_id").alias("id"), "m.n_shingles", "m.sig"))
    postings = cut(prefix_postings(classes, matches))
    let_go(df.sparkSession)
    found = similar_components(docs, classes, postings, words, percent, matches)
    members = classes.select("content", "id").join(found, "id", "left").select("content", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "content").join(members, "content", "left")
    component: Column = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
"""
