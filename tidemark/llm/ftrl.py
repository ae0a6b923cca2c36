"""Follow-the-regularised-leader (proximal) logistic regression on sparse rows, and the labelled sample it learns from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folds by crc32 of the id as text; fold 0 is held out.
FOLDS = 5


def fold_of(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS, F.lit(0))


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, label) of at most `bound` labelled ids outside the held-out fold, those of least hash.

    Null ids and labels don't count; an id with several labels takes the largest. The bound makes it fit a broadcast.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna().filter(fold_of(F.col("doc_id")) != 0)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


class Ftrl:
    """Weights by coordinate; `update` takes one row of distinct indices and values."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.01, l2: float = 0.01):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, idx: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(idx)
        g = (sigmoid(float(w @ x)) - y) * x
        sigma = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] += g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))
