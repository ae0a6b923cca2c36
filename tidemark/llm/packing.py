"""Best-fit packing of token sequences by minimum bin slack.

How pieces fill sequences depends on their lengths alone, so the plan is made on the histogram of lengths: at most
`capacity` numbers, however many documents there are. Each pattern is one bin of minimum slack: the largest length left,
filled up by a subset-sum over the lengths left (bounded by their counts) in bitsets of capacity + 1 bits; the pattern is
used as often as the counts allow, which uses up a length nearly every time. Pieces then find their place from their
rank among the pieces of their length, on the executors.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, cut, read_table, slices

CAPACITY = 2048
#: Pieces of one length that are ranked together, on average: so many, or this part of all pieces if that is more.
RANKED, RANKED_PART = 512, 100_000
#: Bytes that the words kept in a task may take.
_MEMO_BYTES = 48 << 20
#: Runs of marks that are kept.
_MARK_RUNS = 10_000
#: ASCII marks that may follow the letters of a word; an apostrophe may begin a piece of its own, so it is none.
_MARKS = b".,;:!?$%&#*|()[]{}\"+-/<>=@^_~"
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch  # a-z, ß-ö, ø-ÿ


@functools.lru_cache(maxsize=1)
def _tokenizers(path: str):
    """The tokenizer, and the same model without normaliser and splitting pattern, for words that both would leave as they are."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    plain = Tokenizer(whole.model)  # the same model, not a copy
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    plain.model._resize_cache(0)  # words come once
    return whole, plain


class WordIds:
    """Token ids of texts, by the words between ASCII white space; the tokenizer drops white space and merges inside words only.

    Words come with A-Z in lower case, as the tokenizer would make them. A word is its letters and the ASCII marks behind
    them, which are a piece of their own, if the tokenizer leaves each letter as it is: then the letters are one piece that ends with an
    end-of-word token, and many new words go through the model as one text. All other words go through the tokenizer whole.
    """

    def __init__(self, path: str, memo_bytes: int = _MEMO_BYTES):
        self.whole, self.plain = _tokenizers(path)
        self.memo, self.marks, self.letters = Memo(memo_bytes), {}, {}
        self.ends = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for t, i in self.whole.get_vocab(with_added_tokens=True).items() if t.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _steady(self, c: str) -> bool:
        """Whether the tokenizer takes a letter as it is, before marks and beside any other such letter."""
        if (got := self.letters.get(c)) is None:
            joins = unicodedata.name(c, "").startswith("HANGUL") and not unicodedata.name(c).startswith("HANGUL SYLLABLE")  # parts of a syllable compose
            got = c.isalpha() and not unicodedata.combining(c) and not joins and self.whole.normalizer.normalize_str(c) == c
            if got:
                both, one, mark = self._each([c + ".", c, "."])
                got = both == one + mark
            self.letters[c] = got
        return got

    def _plain(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            data, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(data[start:end])
                start = end
        if len(out) != len(words):
            raise ValueError("a word without an end")
        return out

    def learn(self, words: list[bytes]) -> None:
        """Afterwards `self.memo.new` has the ids of all `words`, which are distinct."""
        self.memo.turn(words)
        memo, marks = self.memo.new, self.marks
        new = [w for w in words if w not in memo]
        cores = [w.rstrip(_MARKS) for w in new]
        steady = {c for c in set(cores) if c and (_LATIN(c) or not c.isascii() and all(map(self._steady, c.decode())))}
        plain = [c for c in steady if c not in memo]
        self.memo.update(plain, self._plain(b" ".join(plain).decode().split(" ")) if plain else [])
        odd = [w for w, c in zip(new, cores, strict=True) if c not in steady]
        self.memo.update(odd, self._each([w.decode() for w in odd]))
        tails = [(w, c, w[len(c) :]) for w, c in zip(new, cores, strict=True) if c in steady and len(c) < len(w)]
        more = list({m for _, _, m in tails}.difference(marks))
        marks.update(zip(more, self._each([m.decode() for m in more]), strict=True))
        self.memo.update([w for w, _, _ in tails], [memo[c] + marks[m] for _, c, m in tails])
        if len(marks) > _MARK_RUNS:
            marks.clear()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a binary array, as 32-bit integers. Words are told apart by Arrow; each distinct one is looked up once."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        known = pc.ascii_lower(texts.cast(pa.string()))
        known = pc.if_else(special, texts.cast(pa.string()), known) if pc.any(special).as_py() else known
        lists = pc.ascii_split_whitespace(pc.fill_null(known, ""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if pc.any(special).as_py():  # special tokens count as written
            words = [w if b"<|" in w else w.lower() for w in words]
            self.learn(list(set(words)))
        else:
            self.learn(words)
        memo = self.memo.new
        ids = [memo[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        place = coded.indices.to_numpy()
        long = size[place]
        ends = np.cumsum(long)
        at = np.repeat(start[place] - (ends - long), long)
        at += np.arange(len(at))
        out, bounds = flat[at].tobytes(), (np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4).tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in slices(batches, 1, 4 << 20):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).cast(pa.binary())), strict=True):
                data = ids + b"\0\0\0\0"
                step = 4 * capacity
                out += [(doc_id, k, k * capacity, len(part := data[k * step : (k + 1) * step]) // 4, zlib.crc32(part)) for k in range(-(-len(data) // step))]
            doc, piece, start, length, crc = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `room`: bitset subset-sum, larger lengths preferred."""
    layers, mask, full = [1], (1 << room + 1) - 1, 1 << room
    items: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:  # binary parts of the count
            part = min(part, left)
            items.append((length, part))
            layers.append((layers[-1] | layers[-1] << length * part) & mask)
            left, part = left - part, part * 2
        if layers[-1] & full:
            break
    total, used = layers[-1].bit_length() - 1, {}
    for k in range(len(items), 0, -1):
        if not layers[k - 1] >> total & 1:
            length, part = items[k - 1]
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (count by length in one sequence) and how often each is used."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        used = fullest(left, capacity - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, items in a sequence, offset of the first)."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for used, times in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.setdefault(length, []).append((rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _placed(spots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), spots[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, ranked: int = RANKED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document of `df` into sequences of at most `capacity` tokens.

    A document is its token ids and one id 0; only longer ones are cut, into pieces of `capacity` tokens and a rest. Null and
    empty texts are a piece of one token, repeated rows are packed each, an empty table gives no rows, null keys are kept,
    and other columns are left out. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees a count per length (at most `capacity` rows). A length is dealt into buckets of about `ranked` pieces, or the
    RANKED_PART-th part of all; ranks come from a count per (length, bucket) plus a row number inside the bucket, so no length gathers in one
    task. What is broadcast are those counts: at most `capacity` + RANKED_PART rows of three numbers, some 10 MB, whatever the input.
    """
    spark, docs = df.sparkSession, df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(docs.mapInArrow(_pieces(tokenizer_path, capacity), schema))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spots = places(plan(histogram, capacity))
    ranked = max(ranked, sum(histogram.values()) // RANKED_PART)
    parts = spark.createDataFrame([(k, -(-n // ranked)) for k, n in histogram.items()], "length long, _parts long")
    rows = pieces.join(F.broadcast(parts), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_parts")).drop("_parts")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked_rows = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["length", "_bucket"])
    ranked_rows = ranked_rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("rank"))
    return ranked_rows.mapInArrow(_placed(spots), f"{schema}, sequence_id long, offset long")


def op4_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
