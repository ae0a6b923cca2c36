"""Quality by logistic regression on hashed word n-grams, trained with FTRL updates.

Words count in two forms, as themselves and as their shape (letters by case, digits, punctuation), because an invented
or rare word says less about quality than how words look side by side. Each n-gram has the weight of its share among
the n-grams of its kind, so a score is a bias plus a mean of weights per kind: a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, read_table, slices
from .ftrl import Ftrl, fold_of, labelled_sample, sigmoid

BITS = 18
#: Labelled rows that training reads at most, and the shares that are trained apart and averaged.
SAMPLE, PARTS, EPOCHS = 20_000, 4, 6
THRESHOLD = 0.3
#: Bytes that the words kept in a task may take.
_MEMO_BYTES = 24 << 20
_UPPER, _LOWER, _DIGIT, _RUN = re.compile(r"[^\W\d_a-z]+"), re.compile(r"a+"), re.compile(r"\d+"), re.compile(r"(.)\1{2,}")
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shape(word: str) -> str:
    """Runs of upper-case letters as A, of lower-case ones as a, of digits as 0; other runs keep three characters at most. The whole word counts."""
    letters = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    letters = re.sub(r"A+", "A", _LOWER.sub("a", letters))
    return _RUN.sub(r"\1\1\1", re.sub(r"0+", "0", letters))


class NGrams:
    """Hashed n-grams of a text, by kind. Words met lately keep the places of their two hashes in an array."""

    def __init__(self, bits: int = BITS, memo_bytes: int = _MEMO_BYTES):
        self.shift, self.bound = np.uint64(64 - bits), memo_bytes
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.hashes, self.held = np.zeros((1 << 12, 2), np.uint64), 0

    def _learn(self, word: bytes) -> int:
        text, at = word.decode(), len(self.places) + 1  # 0 is no place
        if at >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = xxhash.xxh3_64_intdigest(text.lower()), xxhash.xxh3_64_intdigest(shape(text))
        self.places[word] = at
        self.held += len(word) + 200
        return at

    def _hashed(self, h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * _PRIME
        return (((h ^ (h >> np.uint64(31))) * _MIX) >> self.shift).astype(np.int64)

    def kinds(self, text: bytes | None) -> list[np.ndarray]:
        found = (text or b"").split()
        if not found:
            return []
        if self.held > self.bound:
            self._clear()
        place, learn = self.places.get, self._learn
        at = np.array([place(w) or learn(w) for w in found])
        w, s = self.hashes[at, 0], self.hashes[at, 1]
        out = [self._hashed(w, 1), self._hashed(s, 3)]
        if len(w) > 1:
            out += [self._hashed(w[:-1] * _MIX + w[1:], 2), self._hashed(s[:-1] * _MIX + s[1:], 4), self._hashed((w[1:] == w[:-1]).astype(np.uint64), 6)]
        if len(w) > 2:
            out.append(self._hashed((s[:-2] * _MIX + s[1:-1]) * _MIX + s[2:], 5))
        return out

    def row(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct indices and values; index 0 is the bias."""
        kinds = self.kinds(text)
        idx, at = np.unique(np.concatenate([np.zeros(1, np.int64), *kinds]), return_inverse=True)
        values = np.concatenate([np.ones(1), *(np.full(len(k), 1 / len(k)) for k in kinds)])
        return idx, np.bincount(at, values)


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights of one share by index, and a row of index -1 that counts the share."""
    grams, model = NGrams(), Ftrl(1 << BITS)
    pdf = pdf.sort_values(["order", "doc_id", "text"])
    rows = []  # as small as they can be: a share is held as a whole
    for t, y in zip(pdf["text"], pdf["label"], strict=True):
        idx, x = grams.row((t or "").encode())
        rows.append((idx.astype(np.int32), x.astype(np.float32), int(y)))
    del pdf, grams
    for _ in range(EPOCHS):
        for idx, x, y in rows:
            model.update(idx, x, y)
    w = model.weights()
    at = np.flatnonzero(w)
    out = pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], 1.0)})
    del rows, model
    give_back()
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights learned from at most `sample` labelled rows: each share trains by itself, weights are averaged over the shares that have rows.

    What comes to the driver is one number per hashed index, 2 ** BITS at most, whatever the input. Without labelled rows
    all weights are 0 and every score is one half. Rows that repeat count each; null texts count as empty.
    """
    picked = F.broadcast(labelled_sample(labels, label, sample))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(picked, "doc_id").withColumn("order", F.xxhash64("doc_id", F.lit(7)))
    rows = rows.withColumn("part", F.pmod("order", F.lit(PARTS)))
    parts = rows.groupBy("part").applyInPandas(lambda pdf: _train(pdf), "i long, w double")
    found = parts.groupBy("i").agg(F.sum("w").alias("w")).toPandas()
    at, w = found["i"].to_numpy(np.int64), found["w"].to_numpy()
    weights = np.zeros(1 << BITS, np.float32)
    if (shares := w[at < 0].sum()) > 0:
        weights[at[at >= 0]] = w[at >= 0] / shares
    return weights


def _scored(weights: np.ndarray, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for batch in slices(batches, at):
            scores = [sigmoid(float(weights[0]) + sum(float(weights[k].mean()) for k in grams.kinds(t.as_py()))) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def with_scores(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of `df`, which has no column of that name, with their `score`."""
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return df.mapInArrow(_scored(weights, df.columns.index(text)), schema)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null, empty and blank texts have the bias alone; repeated rows get a score each; null ids count as held out; an
    empty table gives no rows; other columns are left out.
    """
    rows = with_scores(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), weights)
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
