"""Toxicity of texts whose words may be disguised.

A noisy channel turns letters into look-alikes (leetspeak), spreads them with spaces or points and repeats them. A word
that shows such signs becomes a lattice of the letters each character may stand for; the Viterbi path under a
character trigram model of the corpus restores it. Words without signs have one path, themselves. The restored words
and their first letters are scored by a logistic regression learned from labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .ftrl import Ftrl, fold_of, labelled_sample, sigmoid

#: Labelled rows that training reads at most; features need so many toxic rows, and that share of toxic ones.
SAMPLE, SUPPORT, SHARE, EPOCHS = 20_000, 3, 0.6, 12
THRESHOLD = 0.5
#: Bytes that the words kept in a task may take.
_MEMO_BYTES = 48 << 20
#: Letters that look-alike characters stand for.
LOOKALIKES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou"}
#: Letters the model tells apart: 0 is the end of a word, 1 any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûü"
SIZE = len(LETTERS) + 2
#: Costs in nats: a look-alike for a letter, a letter read as itself, one of a run left out.
_COST = {"lookalike": 0.5, "drop_repeat": 0.3, "keep_repeat": 1.0, "drop_space": 0.2, "keep_space": 1.0}
_CODES = np.zeros(0x110000, np.uint8)
_CODES[[ord(c) for c in LETTERS]] = np.arange(2, SIZE)
_RUNS = re.compile(r"[^\W\d_]+")
_SIGN = "".join(map(re.escape, LOOKALIKES))
#: Of a word without its edge punctuation: a letter and a look-alike, or two equal letters in a row.
_DISGUISED = re.compile(rf"(?=.*[^\W\d_])(?=.*[{_SIGN}])|([^\W\d_])\1", re.DOTALL)
#: Marks around a word; signs that may stand for a letter stay.
_EDGE = ".,;:?\"'`´()[]{}<>&#%/\\«»„“”‚‘’¿¡-_~=^"
_GAP = r"(?:[ \t.\-_/*|,·•]{1,3})"
_SPACED = re.compile(rf"(?<!\w)(?:[^\W\d_]|[{_SIGN}])(?:{_GAP}(?:[^\W\d_]|[{_SIGN}])){{2,}}(?!\w|[{_SIGN}]+\w)")

#: Characters that may be read alike, as one of them; what a reading may leave out goes. A sign for many letters has no one to stand for it.
_MANY = "".join(ch for ch, letters in LOOKALIKES.items() if len(letters) > 2)
_ALIKE = str.maketrans({x: letters[0] for ch, letters in LOOKALIKES.items() if ch not in _MANY for x in ch + letters[1:]} | dict.fromkeys(" .-_"))
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def outline(text: str) -> str:
    """What all readings of a lower-case text without signs for many letters share: if a reading has some letters side by side, its outline has theirs."""
    return _RUN.sub(r"\1", text.translate(_ALIKE))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in slices(batches, 0):
        for text in batch.column(0):
            t = text.as_py()
            if not t:
                continue
            points = np.frombuffer(t.lower().encode("utf-32-le"), "<u4")
            codes = _CODES[points].astype(np.int64)
            other = (codes == 0) & (points > 127)
            codes[other] = 1
            codes = np.concatenate([[0, 0], codes, [0]])
            tri = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
            total += np.bincount(tri[(codes[2:] > 0) | (codes[1:-1] > 0)], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["tri", "n"])


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c], from the letter trigrams of every text; SIZE ** 3 counts at most reach the driver."""
    found = docs.select(F.col(text)).mapInArrow(_counted, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[found["tri"].to_numpy(np.int64)] = found["n"].to_numpy()
    counts = counts.reshape(SIZE, SIZE, SIZE)
    pair = counts.sum(axis=0) + 0.1
    back = pair / pair.sum(axis=1, keepdims=True)
    return np.log((counts + 5 * back[None]) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def _code(letter: str) -> int:
    c = int(_CODES[ord(letter)])
    return c or 1


def _options(ch: str, before: str) -> list[tuple[str, float]]:
    """What a character may stand for, with costs; "" leaves it out, a space ends a reading."""
    if ch in " .-_":
        return [("", _COST["drop_space"]), (" ", _COST["keep_space"])]
    if ch == before:
        return [("", _COST["drop_repeat"]), *((x, _COST["keep_repeat"] + _COST["lookalike"] * (ch in LOOKALIKES)) for x in LOOKALIKES.get(ch, ch))]
    if ch in LOOKALIKES:
        return [(x, _COST["lookalike"]) for x in LOOKALIKES[ch]]
    return [(ch, 0.0)] if ch.isalpha() else [(" ", 0.0)]


def restore(word: str, model: np.ndarray) -> str:
    """The best reading of a lower-case word or of spaced-out letters, of any length; readings part at kept spaces.

    A state is the last two letters; each step keeps, for a state, its cost, the state before and the letter read, and the
    path is followed back at the end.
    """
    now: dict[tuple[int, int], float] = {(0, 0): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    before = ""
    for ch in word:
        then: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for x, more in _options(ch, before):
            for (a, b), cost in now.items():
                if x == "" or x == " " and b == 0:
                    state, c, read = (a, b), cost + more, ""
                else:
                    k = 0 if x == " " else _code(x)
                    state, c, read = (b, k), cost + more - float(model[a, b, k]), x
                if state not in then or c < then[state]:
                    then[state], back[state] = c, ((a, b), read)
        now, before = then, ch
        steps.append(back)
    state = min(now, key=lambda s: (now[s] - float(model[s[0], s[1], 0]) * (s[1] > 0), s))
    out = []
    for back in reversed(steps):
        state, read = back[state]
        out.append(read)
    return "".join(reversed(out))


class Restorer:
    """Features of words: restored readings and their first 4 to 6 letters. With `wanted`, the numbers of those features; words whose outline has none of theirs aren't read."""

    def __init__(self, model: np.ndarray, wanted: dict[str, int] | None = None):
        self.model, self.wanted, self.memo, self.held = model, wanted, {}, 0
        names = set(wanted or ())
        self.whole = {outline(x) for x in names if x[-1] != "*"}
        self.begins: dict[int, set[str]] = {}  # outlines of first letters, by their number
        for x in names:
            if x[-1] == "*":
                self.begins.setdefault(len(o := outline(x[:-1])), set()).add(o)
        self.inside: dict[int, set[str]] = {}
        for o in self.whole.union(*self.begins.values()):
            self.inside.setdefault(len(o[:4]), set()).add(o[:4])

    def telling(self, low: str) -> bool:
        """False if no reading of a lower-case word can have a wanted feature. A word of letters has one reading, whole; in others readings may begin and end anywhere."""
        if self.wanted is None:
            return True
        part = low.strip(_EDGE)
        x = outline(part)
        if part.isalpha():
            return x in self.whole or any(x[:n] in begins for n, begins in self.begins.items())
        if any(ch in part for ch in _MANY):
            return True
        return any(not begins.isdisjoint([x[k : k + n] for k in range(len(x) - n + 1)]) for n, begins in self.inside.items())

    def readings(self, word: str) -> list[str]:
        low = word.lower()
        found = _RUNS.findall(low)
        part = low.strip(_EDGE)
        if _DISGUISED.search(part):
            found += restore(part, self.model).split()
        return found

    @staticmethod
    def named(found: list[str]) -> list[str]:
        return [x for w in found for x in (w, f"{w[:4]}*", f"{w[:5]}*", f"{w[:6]}*")]

    def of_word(self, word: str) -> tuple:
        got = self.memo.get(word)
        if got is None:
            if self.held > _MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            names = self.named(self.readings(word)) if self.telling(word.lower()) else []
            got = self.memo[word] = tuple(names) if self.wanted is None else tuple({self.wanted[x] for x in names if x in self.wanted})
            self.held += 2 * len(word) + 220 + (80 * len(got) if self.wanted is None else 0)
        return got

    def of_text(self, text: str | None) -> set:
        text = text or ""
        out: set = set()
        for word in set(text.split()):
            if got := self.of_word(word):
                out.update(got)
        for m in _SPACED.finditer(text.lower()):
            names = self.named(restore(re.sub(_GAP, " ", m.group()), self.model).split())
            out.update(names if self.wanted is None else {self.wanted[x] for x in names if x in self.wanted})
        return out


def _featured(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(model)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sorted(r.of_text(t.as_py())) for t in batch.column(1)], pa.list_(pa.string()))], ["doc_id", "label", "features"])

    return run


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weights by feature, and the bias under the empty name."""
    rows = pdf.sort_values(["order", "doc_id"])
    found = [list(x) for x in rows["features"]]
    names = sorted({f for x in found for f in x})
    at = {f: k + 1 for k, f in enumerate(names)}
    fit = Ftrl(len(names) + 1, alpha=0.5, beta=1.0, l1=0.5, l2=0.1)
    data = [(np.array([0, *(at[f] for f in x)]), int(y > 0)) for x, y in zip(found, rows["label"], strict=True)]
    for _ in range(EPOCHS):
        for idx, y in data:
            fit.update(idx, np.ones(len(idx)), y)
    w = fit.weights()
    return pd.DataFrame({"f": ["", *(f for f in names if w[at[f]])], "w": [w[0], *(w[at[f]] for f in names if w[at[f]])]})


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> tuple[dict[str, float], float]:
    """Weights by feature, and the bias, from at most `sample` labelled rows.

    Spark counts in how many toxic and other texts of the sample each feature occurs and keeps those that point to toxic
    texts. The fit over what is left of the sample, a few features a document, is one task of at most `sample` rows; its
    weights come to the driver, at most as many as features of at least SUPPORT toxic documents of the sample. Without labelled rows all scores are one half.
    Rows that repeat a doc_id count each when features are counted, and as one document with the features of all in the fit.
    """
    picked = F.broadcast(labelled_sample(labels, label, sample))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(picked, "doc_id").select("doc_id", "text", "label")
    rows = rows.mapInArrow(_featured(model), "doc_id long, label int, features array<string>")
    found = rows.select("doc_id", "label", F.explode("features").alias("f"))
    telling = found.groupBy("f").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n")).filter((F.col("t") >= SUPPORT) & (F.col("t") >= SHARE * F.col("n"))).select("f")
    hits = found.join(telling, "f").groupBy("doc_id").agg(F.sort_array(F.collect_set("f")).alias("features"))
    none = F.array().cast("array<string>")
    data = docs.select(F.col(key).cast("long").alias("doc_id")).join(picked, "doc_id").dropDuplicates(["doc_id"]).join(hits, "doc_id", "left").select("doc_id", "label", F.coalesce("features", none).alias("features"), F.xxhash64("doc_id").alias("order"))
    weights = {r["f"]: r["w"] for r in data.groupBy(F.lit(0).alias("all")).applyInPandas(_fitted, "f string, w double").collect()}
    bias = weights.pop("", 0.0)
    return weights, bias


def _scored(model: np.ndarray, weights: dict[str, float], bias: float):
    names = list(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, values = Restorer(model, {f: k for k, f in enumerate(names)}), list(weights.values())
        for batch in slices(batches, 1):
            scores = [float(sigmoid(bias + sum(values[k] for k in sorted(r.of_text(t.as_py()))))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: np.ndarray, weights: dict[str, float], bias: float, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    Null, empty and blank texts have the bias alone; repeated rows get a score each; null ids count as held out; an
    empty table gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scored(model, weights, bias), "doc_id long, score double")
    return rows.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = letter_model(docs)
    return score(docs, model, *train(docs, read_table(spark, sf_dir, "labels"), model))
