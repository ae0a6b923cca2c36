"""Hard negatives by lists that clusters of anchors share.

Anchors are clustered by direction. No member of a cluster is further than its radius from its centre, so a candidate's score with any member is at most
both lengths times the cosine of (the candidate's angle to the centre less the radius). Candidates are dealt into blocks of bounded size; in
each block the candidates are sorted by this bound once for every cluster, and the lists are written. Each member of a cluster walks the
cluster's list, first for its positives, then for the negatives of each, and stops where the bound of the next candidate
is below what it has found or may take: what was not looked at is certified not to matter. So results are exact; how far
lists are walked depends on how narrow the clusters are. Tasks hold a batch of anchors and read their blocks one after the other, in whole steps of candidates.

Scores are exact integers. Rows with numbers so large that scores might leave 53 bits lie in small blocks of their own, and they and anchors like
them are worked with Python's integers and without bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bit_sliced import LONG_MAX, LONG_MIN, beyond, integers, quantised
from .common import cut, give_back, read_table

#: Rows in a block on average, of rows with large numbers, anchors in a batch on average, anchors in a step, tasks for each core.
BLOCK_ROWS, WIDE_ROWS, BATCH_ANCHORS, MEMBERS, TASKS = 8192, 128, 131_072, 512, 2
#: Candidates that a walk takes at once.
STEP = 1024
#: Clusters of anchors, anchors of least hash that they are fitted on at most, and rounds of the fit.
CLUSTERS, SAMPLE, ROUNDS = 16, 4096, 12
#: Sums of absolute components up to which the scores of two vectors are exact as doubles.
NARROW = 1 << 26
SCALE = 256


@dataclass(frozen=True)
class Rule:
    """What is mined: positives of an anchor, negatives of each, and the shares (in hundredths) of the positive's score that a negative's lies between."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95


def _wide(scale: int) -> Column:
    return F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v)) * scale + F.size("x") >= float(NARROW)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (zero rows stay zero) and lengths."""
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None], size


def centres(x: np.ndarray, clusters: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spread rows; as many centres as there are distinct starts at most."""
    unit = np.unique(directions(x)[0], axis=0)
    at = unit[np.linspace(0, len(unit) - 1, min(clusters, len(unit))).astype(int)]
    for _ in range(rounds):
        own = (unit @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, unit)
        at = np.where((np.abs(sums).sum(1) > 0)[:, None], directions(sums)[0], at)
    return at


def _angles(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of each row to each centre, and lengths; dimensions that one side lacks are 0."""
    unit, size = directions(x)
    d = min(unit.shape[1], at.shape[1])
    return np.arccos(np.clip(unit[:, :d] @ at[:, :d].T, -1, 1)), size


def _fitted(clusters: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [q for pdf in batches for q in pdf.sort_values("row")["q"]]
        if found:
            at = centres(integers(found, 1, False).astype(float), clusters)
            yield pd.DataFrame({"cluster": np.arange(len(at), dtype=np.int32), "centre": list(at)})

    return run


def _assigned(at: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cluster, angle = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            if len(at) and (narrow := np.flatnonzero(~pdf["wide"].to_numpy(bool))).size:
                angles = _angles(integers(pdf["q"].iloc[narrow].to_list(), 1, False).astype(float), at)[0]
                cluster[narrow] = angles.argmin(1)
                angle[narrow] = angles.min(1)
            yield pdf.assign(cluster=cluster, angle=angle)

    return run


_INDEX = "block int, wide boolean, dims int, ids binary, rows binary, labels binary, vectors binary, orders binary, bounds binary"


def _indexed(scale: int, at: np.ndarray, radius: np.ndarray):
    """A block's rows, and for every cluster their order by the bound of scores with its members, over the member's length; bounds are rounded up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"])
        wide = bool(pdf["wide"].iloc[0])
        q = integers(pdf["x"].to_list(), scale, True) if wide else integers(pdf["q"].to_list(), 1, False)
        orders, bounds, vectors = b"", b"", b""
        if wide:
            vectors = b"\n".join(" ".join(map(str, row)).encode() for row in q.tolist())
        else:
            vectors = q.astype("<i4").tobytes()
            angles, size = _angles(q.astype(float), at)
            reach = size[:, None] * np.minimum(1, np.cos(np.clip(angles - radius[None], 0, math.pi)) + 1e-7)
            order = np.argsort(-reach, axis=0, kind="stable")
            sorted_reach = np.take_along_axis(reach, order, 0)
            orders, bounds = order.T.astype("<i4").tobytes(), np.nextafter(sorted_reach.T.astype("<f4"), np.float32(np.inf)).astype("<f4").tobytes()
        raw = lambda c, kind: pdf[c].to_numpy(kind).tobytes()
        return pd.DataFrame({
            "block": [int(pdf["block"].iloc[0])], "wide": [wide], "dims": [q.shape[1]], "ids": [raw("vec_id", "<i8")], "rows": [raw("row", "<i8")], "labels": [raw("label", "<i8")],
            "vectors": [vectors], "orders": [orders], "bounds": [bounds],
        })

    return run


# ---- walks


class Best:
    """The best k (score, id, row) of each of n slots; higher scores come first, then smaller ids and rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.slot, self.score, self.id, self.row = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))
        self.last = np.full(n, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, rows = np.concatenate([self.id, ids]), np.concatenate([self.row, rows])
        order = np.lexsort((rows, ids, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, slot, rank = order[rank < self.k], slot[rank < self.k], rank[rank < self.k]
        self.slot, self.score, self.id, self.row = slot, score[order], ids[order], rows[order]
        full = rank == self.k - 1
        self.last[slot[full]] = self.score[full]


@dataclass
class Anchors:
    """A batch of anchors of one cluster: windows (low, high, slot's anchor) say what a slot takes; without positives each anchor is one slot that takes anything."""

    q: np.ndarray
    size: np.ndarray
    label: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    best: Best
    same: bool
    seen: int = 0

    def walk(self, block: dict, cluster: int, step: int = STEP) -> None:
        """Take the block's candidates in the order of the cluster's list; anchors that nothing further can matter to leave."""
        slots = self.low.shape[1]
        active = np.arange(len(self.q))
        order, bound = block["orders"][cluster], block["bounds"][cluster]
        for at in range(0, len(order), step):
            reach = bound[at] * self.size[active] * (1 + 1e-9) + 1e-3
            last = self.best.last.reshape(-1, slots)[active]
            open_ = (reach[:, None] >= np.maximum(last, self.low[active])) & (self.low[active] <= self.high[active])
            active = active[open_.any(1)]
            if not len(active):
                break
            take = order[at : at + step]
            self.seen += len(take) * len(active)
            d = min(self.q.shape[1], block["x"].shape[1])
            scores = self.q[active, :d] @ block["x"][take, :d].T
            fits = self.label[active][:, None] == block["labels"][take][None]
            fits = fits & (self.row[active][:, None] != block["rows"][take][None]) if self.same else ~fits
            for j in range(slots):
                floor = np.maximum(self.best.last.reshape(-1, slots)[active, j], self.low[active, j])
                hit = fits & (scores >= floor[:, None]) & (scores <= self.high[active, j][:, None])
                self._add(active, j, slots, scores, hit, take, block)

    def _add(self, active: np.ndarray, j: int, slots: int, scores: np.ndarray, hit: np.ndarray, take: np.ndarray, block: dict) -> None:
        k = self.best.k
        dense = hit.sum(1) > 8 * k
        if dense.any():  # only what may be among the best k of the step
            some = np.where(hit[dense], scores[dense], -np.inf)
            hit[dense] &= some >= -np.partition(-some, k - 1, axis=1)[:, k - 1 : k]
        m, c = np.nonzero(hit)
        self.best.add(active[m] * slots + j, scores[m, c], block["ids"][take[c]], block["rows"][take[c]])


def _ints(text: bytes) -> list[list[int]]:
    return [list(map(int, line.split())) for line in text.split(b"\n")]


def _opened(r: dict, clusters: int) -> dict:
    n = len(r["ids"]) // 8
    block = {"wide": r["wide"]} | {k: np.frombuffer(r[k], "<i8") for k in ("ids", "rows", "labels")}
    if r["wide"]:
        block["exact"] = _ints(r["vectors"])
        return block
    block["x"] = np.frombuffer(r["vectors"], "<i4").reshape(n, r["dims"]).astype(float)
    block["exact"] = None
    block["orders"], block["bounds"] = np.frombuffer(r["orders"], "<i4").reshape(clusters, n), np.frombuffer(r["bounds"], "<f4").reshape(clusters, n).astype(float)
    return block


def exact_value(score: int, over: str | None) -> int:
    """The integer behind a clipped score and its text (see `beyond`)."""
    if over is None:
        return score
    digits = over[5:]
    return int(digits) if score > 0 else -int("".join(str(9 - int(d)) for d in digits))


def windows(score: int, rule: Rule) -> tuple[int, int]:
    """The least and greatest score of a negative for a positive's score."""
    return -(-rule.least * score // 100), rule.most * score // 100


_FOUND = "row long, query_id long, slot int, positive_id long, positive_score long, vec_id long, candidate long, score long, beyond string"


def _walked(rule: Rule, scale: int, clusters: int, same: bool):
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("slot", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("candidate", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])
    k = rule.positives if same else rule.negatives

    class Batch:
        """The anchors of a cell: in arrays by cluster, and those that need Python's integers one by one; what an anchor finds in blocks of large numbers is kept beside."""

        def __init__(self, asked: list[dict]):
            self.asked, self.groups, self.exact, self.beside = asked, [], [], {}
            slots = 1 if same else rule.positives
            narrow: dict[int, list[int]] = {}
            for i, a in enumerate(asked):
                pos = [] if same else [exact_value(p["score"], p["beyond"]) for p in a["found"]]
                a["windows"] = [(None, None)] if same else [windows(s, rule) for s in pos]
                if a["wide"] or any(max(abs(w[0]), abs(w[1])) >= 1 << 53 for w in a["windows"] if w[0] is not None):
                    self.exact.append((i, [[] for _ in a["windows"]]))
                else:
                    narrow.setdefault(a["cluster"], []).append(i)
            for cluster, members in sorted(narrow.items()):
                for at in range(0, len(members), MEMBERS):
                    part = members[at : at + MEMBERS]
                    q = integers([np.array(asked[i]["q"]) for i in part], 1, False).astype(float)
                    low, high = np.full((len(part), slots), np.inf), np.full((len(part), slots), -np.inf)
                    for n, i in enumerate(part):
                        for j, (a, b) in enumerate(asked[i]["windows"]):
                            low[n, j], high[n, j] = (-np.inf, np.inf) if a is None else (a, b)
                    label, row = (np.array([asked[i][c] for i in part], np.int64) for c in ("label", "row"))
                    self.groups.append((cluster, part, Anchors(q, directions(q)[1], label, row, low, high, Best(len(part) * slots, k), same)))

        def read(self, block: dict) -> None:
            for cluster, part, group in self.groups:
                if block["wide"]:
                    for i in part:
                        self._exactly(self.asked[i], block, self.beside.setdefault(i, [[] for _ in self.asked[i]["windows"]]))
                else:
                    group.walk(block, cluster)
            for i, best in self.exact:
                self._exactly(self.asked[i], block, best)

        def _exactly(self, a: dict, block: dict, best: list[list[tuple]]) -> None:
            """Scores as Python's integers, STEP candidates at a time."""
            x = block["exact"] or block["x"].astype(int).tolist()
            q = integers([np.array(a["x"], float)], scale, True)[0].tolist() if a["wide"] else a["q"]
            for at in range(0, len(x), STEP):
                some = [(-sum(p * c for p, c in zip(q, row, strict=False)), int(i), int(r), int(z)) for row, i, r, z in zip(x[at : at + STEP], block["ids"][at:], block["rows"][at:], block["labels"][at:], strict=False)]
                for j, (low, high) in enumerate(a["windows"]):
                    fits = [(s, i, r) for s, i, r, z in some if ((z == a["label"] and r != a["row"]) if same else z != a["label"]) and (low is None or low <= -s <= high)]
                    best[j] = sorted([*best[j], *fits])[:k]

        def answers(self) -> pa.RecordBatch:
            out: list[tuple] = []
            for _, part, group in self.groups:
                slots = group.low.shape[1]
                b = group.best
                for slot, score, i, r in zip(b.slot.tolist(), b.score.tolist(), b.id.tolist(), b.row.tolist(), strict=True):
                    out.append(self._row(self.asked[part[slot // slots]], slot % slots, int(score), i, r))
            for i, best in [*self.exact, *self.beside.items()]:
                out += [self._row(self.asked[i], j, -s, c, r) for j, found in enumerate(best) for s, c, r in found]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True) if out else [()] * len(schema), schema, strict=True)], schema=schema)

        @staticmethod
        def _row(a: dict, j: int, score: int, i: int, r: int) -> tuple:
            positive = (None, None) if same else (a["found"][j]["vec_id"], a["found"][j]["score"])
            return a["row"], a["vec_id"], j, *positive, i, r, min(max(score, LONG_MIN), LONG_MAX), beyond(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, batch = None, [], None
        for b in batches:
            for r in b.to_pylist():
                if r["cell"] != cell:
                    if asked:
                        yield (batch or Batch(asked)).answers()
                    cell, asked, batch = r["cell"], [], None
                if r["ids"] is None:
                    asked.append(r)
                elif asked:
                    batch = batch or Batch(asked)
                    batch.read(_opened(r, clusters))
        if asked:
            yield (batch or Batch(asked)).answers()
        give_back()

    return run


_POSITIVE = "array<struct<vec_id:long,score:long,beyond:string>>"


def _cells(index: DataFrame, anchors: DataFrame, groups: int, parts: int) -> DataFrame:
    """Anchors and then blocks of each (group of blocks, batch of anchors)."""
    cell = lambda group, part: (F.col(group) * parts + F.col(part)).cast("int").alias("cell")
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asked = anchors.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own, blocks = ["row", "vec_id", "x", "q", "label", "cluster", "found"], [f.split()[0] for f in _INDEX.split(", ")[2:]]
    kinds = dict(f.split(" ", 1) for f in _INDEX.split(", "))
    asked = asked.select(cell("group", "part"), F.lit(-1).alias("block"), "wide", *own, *[null(c, kinds[c]) for c in blocks])
    read = index.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    types = {"row": "long", "vec_id": "long", "x": "array<double>", "q": "array<int>", "label": "long", "cluster": "int", "found": _POSITIVE}
    read = read.select(cell("group", "part"), "block", "wide", *[null(c, types[c]) for c in own], *blocks)
    return asked.unionByName(read).repartition(groups * parts, "cell").sortWithinPartitions("cell", "block")


def mine(vectors: DataFrame, wanted: str, rule: Rule | None = None, scale: int = SCALE, clusters: int = CLUSTERS, block_rows: int = BLOCK_ROWS, batch_anchors: int = BATCH_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best negatives of each positive of the rows that `wanted`, a condition on vec_id, takes as anchors.

    `vectors` is (vec_id, x, label); rows with a null there or a component that is not finite are to be left out before (see `labelled`). A score is the inner product of floor(scale * component);
    a shorter vector counts as 0 beyond its end. Higher scores come first, ties by the smaller vec_id. Positives are other rows of the anchor's label, negatives rows of another
    label whose score lies within the rule's shares of the positive's. Rows that repeat an id are anchors, positives and negatives of their own. A positive without
    negatives, an anchor without positives and an empty table give no rows. A score that 64 bits can't hold is ranked exactly and given as the nearest long.
    """
    rule, spark = rule or Rule(), vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", F.col("label").cast("long").alias("label"), F.coalesce(F.expr(wanted), F.lit(False)).alias("anchor"), _wide(scale).alias("wide"))
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("int"))
    rows = cut(rows.withColumn("q", F.when(~F.col("wide"), whole)).withColumn("x", F.when(F.col("wide"), F.col("x"))))  # numbers that few bytes hold
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("anchor").cast("int")), F.lit(0)).alias("anchors"), F.coalesce(F.sum(F.col("wide").cast("int")), F.lit(0)).alias("wide")).first()
    groups = max(1, TASKS * spark.sparkContext.defaultParallelism)
    blocks, parts = groups * max(1, math.ceil(n["rows"] / groups / block_rows)), max(1, math.ceil(n["anchors"] / batch_anchors))
    wide_blocks = max(1, math.ceil(n["wide"] / WIDE_ROWS))
    anchors = rows.filter("anchor").select("row", "vec_id", "x", "q", "label", "wide")
    sample = anchors.filter("not wide").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "q").coalesce(1)
    at = np.array([r["centre"] for r in sample.mapInPandas(_fitted(clusters), "cluster int, centre array<double>").orderBy("cluster").collect()])
    at = at if len(at) else np.zeros((1, 1))
    anchors = cut(anchors.mapInPandas(_assigned(at), "row long, vec_id long, x array<double>, q array<int>, label long, wide boolean, cluster int, angle double"))
    radius = np.zeros(len(at))
    for r in anchors.groupBy("cluster").agg(F.max("angle").alias("angle")).collect():
        radius[r["cluster"]] = r["angle"] + 1e-6
    block = F.when(F.col("wide"), blocks + F.pmod(F.xxhash64("row"), F.lit(wide_blocks))).otherwise(F.pmod(F.xxhash64("row"), F.lit(blocks))).cast("int")
    index = cut(rows.select("row", "vec_id", "x", "q", "label", "wide", block.alias("block")).groupBy("block").applyInPandas(_indexed(scale, at, radius), _INDEX))
    order = [F.desc("score"), F.desc_nulls_last("beyond"), F.asc("vec_id"), F.asc("candidate")]
    found = _cells(index, anchors.withColumn("found", F.lit(None).cast(_POSITIVE)), groups, parts).mapInArrow(_walked(rule, scale, len(at), True), _FOUND)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).filter(F.col("rank") <= rule.positives)
    positives = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "beyond"))).alias("found"))
    positives = positives.select("row", F.transform("found", lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"), p["beyond"].alias("beyond"))).alias("found"))
    anchors = cut(anchors.join(positives, "row").select("row", "vec_id", "x", "q", "label", "wide", "cluster", "found"))
    found = _cells(index, anchors, groups, parts).mapInArrow(_walked(rule, scale, len(at), False), _FOUND)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "slot").orderBy(*order))).filter(F.col("rank") <= rule.negatives)
    return found.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(df: DataFrame) -> DataFrame:
    """(vec_id, x, label) of rows with an id, a label and finite components only, where ids divisible by 7 are given the next label of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return quantised(df.filter(F.col("label").isNotNull()).select("vec_id", "embedding", label.cast("long").alias("label")), carry=["label"])


def op13_shared_list_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(labelled(read_table(spark, sf_dir, "embeddings")), "vec_id % 50 = 0")


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
"""
