"""Scores of texts under a language model with causal self-attention over subword ids, and under word counts.

The corpus is cut into blocks of bounded size once: a block has its distinct words, and its documents as places among them. The words travel once a block, in
parts by their hash: a part has all blocks' occurrences of its words, so there each word is counted and cut into subwords once, and
each block gets the counts and subword ids of its words back. Subword counts and counts of neighbouring classes come from all blocks. Subwords fall into classes by
their counts, frequent ones alone, others in classes of like mass, and P(id | before) = P(class | before) * P(id | class). The class's logits are the counted log-probabilities of its
neighbour plus what one head of causal attention with a feed-forward layer adds. That part is trained in numpy by Adam: in every round each task goes on from the
same weights over its own blocks, and the weights are averaged by the positions that they have seen.

A text is END, its ids, END. Windows of 2 * SPAN positions overlap by half: the second half is scored, every position once, and sees itself and what
lies before it in the window, never another text; windows are worked in batches with a mask.
"""

from __future__ import annotations

import copy
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, let_go, read_table, slices, written
from .packing import WordIds

#: Positions that a window scores, after as many that it only sees; numbers per position; units of the feed-forward layer; classes, and how many of them are one subword's own.
SPAN, WIDTH, HIDDEN, CLASSES, OWN = 16, 16, 32, 128, 96
#: Rounds of training, each over texts of its own; the part of the training texts (one in so many) that they see together: all; windows in a step and in a batch of scoring.
ROUNDS, EVERY, STEP, BATCH = 3, 1, 64, 256
RATE = 0.01
#: Bytes of text in a block, and of the words kept in a task.
BLOCK_BYTES, MEMO_BYTES = 4 << 20, 16 << 20
#: Words of all blocks in a part, at least and at most; between these, so many parts.
PART, PART_MOST, PARTS = 1 << 17, 1 << 20, 2048
#: Frequent words of a block, which have its lowest places; the others follow in the order of their hashes.
FREQUENT = 4096
#: Folds by crc32 of the id as text; this one is held out.
FOLDS, HELD_OUT = 7, 2
END = 0
#: A place that holds no class.
PAD = CLASSES


# ---- blocks


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


_BLOCK = "block long, doc_ids array<long>, sizes binary, places binary, words binary, counts binary, n int, tokens long"


def _blocks(block_bytes: int):
    """Blocks of texts: how many words each has, all words as places among the block's distinct ones, these joined by newlines, and their counts in training texts. The first word, "", is a text's end."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n", pa.int32()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, block_bytes):
            doc_ids = batch.column(0).to_pylist()
            lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(batch.column(1)), ""))
            coded = lists.flatten().dictionary_encode()
            place, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(bounds)
            blank = pc.index(coded.dictionary, "").as_py()
            if blank >= 0:  # what splitting leaves at the edges is no word
                real = place != blank
                sizes = np.add.reduceat(np.append(real, False), np.minimum(bounds[:-1], len(real))) * (sizes > 0)
                place = place[real]
            hashes = _hashes(coded.dictionary)
            often = np.bincount(place, minlength=len(hashes))
            order = np.argsort(-often, kind="stable")
            order[FREQUENT:] = (rest := order[FREQUENT:])[np.argsort(hashes[rest], kind="stable")]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(1, len(order) + 1)
            place = rank[place]
            train = np.array([not held_out(d) for d in doc_ids], bool)
            counts = np.bincount(place[np.repeat(train, sizes)], minlength=len(order) + 1)
            counts[0] = train.sum()
            words = pa.concat_arrays([pa.array([""], pa.string()), coded.dictionary.take(pa.array(order))])
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            raw = lambda v: pa.array([_packed(v)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(0, 1), one(batch.column(0)), raw(sizes), raw(place), _joined(words, np.array([0, len(words)])), raw(counts), pa.array([len(words)], pa.int32()), pa.array([counts.sum()], pa.int64())], schema=schema)

    return run


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes each as the largest takes."""
    most = int(values.max(initial=0))
    return values.astype(next(kind for kind in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(kind).max))


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n if n else 1}")


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on, compressed: first all lowest bytes, then the next ones."""
    values = _narrow(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return len(values).to_bytes(8, "little") + planes.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    planes = np.frombuffer(pa.decompress(data[16:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(f"<u{size // n}").ravel() if n else planes


def _opened(r: dict) -> dict:
    """A block as `Block` takes it."""
    kinds = {"sizes": "<i4", "places": "<i4", "lengths": "<u2"}
    return r | {c: _unpacked(r[c]).astype(kind).tobytes() for c, kind in kinds.items()} | {"ids": (ids := _unpacked(r["ids"])).astype("<u2" if ids.itemsize <= 2 else "<u4").tobytes()}


def _joined(words: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Words in lists that begin and end at `bounds`, each list joined by newlines."""
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.cast(pa.string()))
    return pc.binary_join(lists, "\n").cast(pa.binary())


def _cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binaries that hold the numbers between bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype("<i4")), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of `values`, one after the other."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return values[at]


_DEALT = "part int, block long, words binary, counts binary, places binary"


def _dealt(parts: int):
    """Blocks' words by part: in each the frequent ones with their places, then the others, which follow each other in the block as the parts do."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = pc.split_pattern(batch.column("words").slice(k, 1).cast(pa.string()), "\n").flatten()
                part = ((_hashes(words) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                first = np.bincount(part[: FREQUENT + 1], minlength=parts)
                there = np.flatnonzero(sizes := np.bincount(part, minlength=parts))
                bounds, firsts = np.append(0, np.cumsum(sizes[there])), np.append(0, np.cumsum(first[there]))
                counts, places = _narrow(_unpacked(batch.column("counts")[k].as_py())), order[order <= FREQUENT].astype("<u2")
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.repeat(batch.column("block")[k], len(there)), _joined(words.take(pa.array(order)), bounds), _cut(counts[order], bounds), _cut(places, firsts)], schema=schema)

    return run


_LOOKED_UP = "part int, block long, distinct long, n int, places binary, known binary, ids binary, lengths binary"


@functools.lru_cache(maxsize=1)
def _subwords(path: str) -> WordIds:
    return WordIds(path, MEMO_BYTES)


def _looked_up(path: str):
    """Of one part, each block's words with their counts in all training texts and their subword ids; each word is cut into subwords once."""
    kind = "<u2" if _vocabulary(path) <= 1 << 16 else "<u4"
    names = ["part", "block", "distinct", "n", "places", "known", "ids", "lengths"]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        blobs = table["words"].combine_chunks()
        lists = pc.split_pattern(blobs.cast(pa.string()), "\n")
        coded = lists.flatten().dictionary_encode()
        bounds, at = lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy()
        bounds = bounds - bounds[0]
        counts = np.concatenate([_wide(c, n).astype(float) for c, n in zip(table["counts"].to_pylist(), np.diff(bounds).tolist(), strict=True)])
        known = np.bincount(at, counts, len(coded.dictionary)).astype("<i8")
        words, subwords = coded.dictionary.cast(pa.binary()).to_pylist(), _subwords(path)
        subwords.learn(words)
        ids = [subwords.memo.new[w] for w in words]
        subwords.memo = Memo(MEMO_BYTES)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat, starts = np.frombuffer(b"".join(ids), "<u4").astype(kind), np.cumsum(lengths) - lengths
        runs = _runs(flat, starts[at], lengths[at])
        ends = np.append(0, np.cumsum(lengths[at]))
        distinct = np.zeros(table.num_rows, np.int64)
        distinct[:1] = (known > 0).sum()
        return pa.Table.from_arrays([table["part"], table["block"], pa.array(distinct), pa.array(np.diff(bounds), pa.int32()), table["places"], _cut(_narrow(known)[at], bounds), _cut(runs, ends[bounds]), _cut(_narrow(lengths)[at], bounds)], names)

    return run


_TEXTS = "block long, doc_ids array<long>, sizes binary, places binary, counts binary, tokens long, distinct long, known binary, ids binary, lengths binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts and ids of their words in the order of their places."""
    for batch in batches:
        for k in range(batch.num_rows):
            parts = sorted(batch.column("parts")[k].as_py(), key=lambda r: r["part"])
            n = np.array([r["n"] for r in parts])
            firsts = [np.frombuffer(r["places"], "<u2") for r in parts]
            known, lengths = (np.concatenate([_wide(r[c], r["n"]).astype(np.int64) for r in parts]) for c in ("known", "lengths"))
            ids = np.frombuffer(b"".join(r["ids"] for r in parts), _width(sum(len(r["ids"]) for r in parts), int(lengths.sum())))
            order, ahead = np.empty(len(lengths), np.int64), np.arange(len(lengths)) - np.repeat(np.cumsum(n) - n, n) < np.repeat([len(f) for f in firsts], n)
            frequent = int(ahead.sum())
            order[np.concatenate(firsts)], order[frequent:] = np.flatnonzero(ahead), np.flatnonzero(~ahead)
            made = [known[order], _runs(ids, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in ("block", "doc_ids", "sizes", "places", "counts", "tokens")], pa.array([sum(r["distinct"] for r in parts)], pa.int64()), *[pa.array([_packed(v)], pa.binary()) for v in made]], ["block", "doc_ids", "sizes", "places", "counts", "tokens", "distinct", "known", "ids", "lengths"])


def _width(size: int, n: int) -> str:
    """The kind of ids that take so many bytes."""
    return "<u2" if size == 2 * n else "<u4"


class Block:
    """A block with the numbers of its texts at hand."""

    def __init__(self, r: dict):
        raw = lambda c, kind="<i4": np.frombuffer(r[c], kind)
        self.doc_ids, self.sizes, self.places = r["doc_ids"], raw("sizes").astype(np.int64), raw("places")
        self.lengths = raw("lengths", "<u2").astype(np.int64)
        self.ids = raw("ids", _width(len(r["ids"]), self.lengths.sum()))
        self.held = np.array([held_out(d) for d in self.doc_ids], bool)

    def only(self, wanted: np.ndarray) -> Block:
        """The block with some of its texts."""
        out = copy.copy(self)
        out.doc_ids, out.held = [d for d, w in zip(self.doc_ids, wanted, strict=True) if w], self.held[wanted]
        out.sizes, out.places = self.sizes[wanted], self.places[np.repeat(wanted, self.sizes)]
        return out

    def texts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, classes, n): END and the ids of each text one after the other and an END at last, their classes, and how many each text has to be scored, its end included."""
        starts = np.cumsum(self.lengths) - self.lengths
        long = self.lengths[self.places]
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = np.bincount(of, long, minlength=len(self.sizes)).astype(np.int64)
        at = np.repeat(starts[self.places] - (np.cumsum(long) - long), long) + np.arange(long.sum())
        ids = np.full(len(at) + len(n) + 1, len(classes) - 1, np.int64)  # the last id is END
        ids[np.arange(len(at)) + np.repeat(np.arange(1, len(n) + 1), n)] = self.ids[at]
        return ids, classes[ids], n + 1


def neighbour_counts(b: Block, classes: np.ndarray) -> np.ndarray:
    """How often a class follows another in the texts that are not held out: inside words by the dictionary, between words by the texts' places."""
    c, end = classes[b.ids], classes[-1]
    places = b.places[np.repeat(~b.held, b.sizes)]
    sizes = b.sizes[~b.held]
    times = np.bincount(places, minlength=len(b.lengths))
    word = np.repeat(np.arange(len(b.lengths)), b.lengths)
    inner = word[:-1] == word[1:]
    pair = lambda x, y, w=None: np.bincount(x * CLASSES + y, w, CLASSES * CLASSES)
    total = pair(c[:-1][inner], c[1:][inner], times[word[:-1][inner]].astype(float))
    some = b.lengths > 0
    starts = np.cumsum(b.lengths) - b.lengths
    first, last = np.full(len(some) + 1, end), np.full(len(some) + 1, end)  # the last word is END
    first[:-1][some], last[:-1][some] = c[starts[some]], c[(starts + b.lengths - 1)[some]]
    real = some[places]  # words without ids leave no trace
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), real, len(sizes)).astype(np.int64)
    places = places[real]
    row = np.full(len(places) + len(sizes) + 1, len(some), np.int64)
    row[np.arange(len(places)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = places
    return total + pair(last[row[:-1]], first[row[1:]]) if len(sizes) else total


class Windows:
    """Texts of a sequence in rows of SPAN positions, each text after a row of PAD: a window is a row that is scored and the row before it."""

    def __init__(self, seq: np.ndarray, n: np.ndarray):
        rows = 1 + -(-n // SPAN)
        lead = np.cumsum(rows) - rows
        at = np.repeat((lead + 1) * SPAN - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.classes, self.targets = np.full(rows.sum() * SPAN, PAD, np.int64), np.full(rows.sum() * SPAN, PAD, np.int64)
        self.classes[at], self.targets[at] = seq[:-1], seq[1:]
        self.pairs = np.lib.stride_tricks.sliding_window_view(self.classes, 2 * SPAN)[::SPAN]  # two rows beside each other
        self.targets = self.targets.reshape(-1, SPAN)
        self.text = np.repeat(np.arange(len(n)), rows)
        real = np.ones(rows.sum(), bool)
        real[lead] = False
        self.rows = np.flatnonzero(real)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, targets) of the windows that score these rows; PAD where there is no position."""
        return self.pairs[rows - 1], self.targets[rows]


# ---- the model


def shapes() -> dict[str, tuple[int, ...]]:
    return {
        "embed": (CLASSES, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "near": (2 * SPAN,),
        "up": (WIDTH, HIDDEN), "bias": (HIDDEN,), "down": (HIDDEN, WIDTH), "out": (WIDTH, CLASSES),
    }


def start_weights(seed: int = 11) -> np.ndarray:
    """All weights in one array: small random numbers, and zeros for the output, so that an untrained model is the counted one."""
    rng = np.random.default_rng(seed)
    parts = [np.zeros(s) if k in ("out", "near", "bias") else rng.normal(0, 1 / math.sqrt(s[-1]), s) for k, s in shapes().items()]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        out[k] = flat[at : at + math.prod(s)].reshape(s)
        at += math.prod(s)
    return out


#: Of query t of a window and its key k: whether it may look there, and how far back that is.
_T, _K = np.arange(SPAN)[:, None], np.arange(2 * SPAN)[None]
CAUSAL, BACK = _K <= _T + SPAN, np.maximum(_T + SPAN - _K, 0)


#: Positions whose logits are worked at a time, few enough for a core's own cache.
CHUNK = 352


class Attention:
    """One head of causal attention over classes, a feed-forward layer, and logits on top of `base`, counted logits by class before."""

    def __init__(self, weights: np.ndarray, base: np.ndarray):
        self.flat, self.p, self.base = weights, views(weights), np.vstack([base, np.zeros_like(base[:1])])
        self.ones = np.ones(CLASSES, weights.dtype)
        self.prepare()

    def prepare(self) -> None:
        """Tables over all classes, with a last row of zeros for PAD, which nothing attends to."""
        p, kind = self.p, self.flat.dtype
        self.ask = p["query"] / np.sqrt(kind.type(WIDTH))
        self.told = np.concatenate([p["key"], p["value"]], 1)
        self.q, self.kv, self.embed = np.zeros((CLASSES + 1, WIDTH), kind), np.zeros((CLASSES + 1, 2 * WIDTH + 1), kind), np.zeros((CLASSES + 1, WIDTH), kind)
        self.embed[:-1] = p["embed"]
        np.matmul(p["embed"], self.ask, out=self.q[:-1])
        self.kv[:-1, :-1] = p["embed"] @ self.told
        self.kv[:-1, -1] = 1  # sums the exponentials
        self.tame = WIDTH * max(self.q.max(), -self.q.min()) * max((k := self.kv[:, :WIDTH]).max(), -k.min()) < 30
        self.far = np.where(CAUSAL.T, np.exp(np.clip(p["near"], -30, 30))[BACK.T], kind.type(0))
        self.out = np.ascontiguousarray(p["out"].T)

    def _seen(self, keys: np.ndarray) -> tuple[np.ndarray, tuple]:
        """What the layers make of each position (windows * SPAN, WIDTH), and what their gradient needs; `keys` are classes (windows, 2 * SPAN)."""
        asks = keys[:, SPAN:]
        q, kv, own = self.q.take(asks, 0), self.kv.take(keys, 0), self.embed.take(asks.ravel(), 0)
        s = kv[:, :, :WIDTH] @ np.ascontiguousarray(q.swapaxes(1, 2))  # keys by queries
        if not self.tame:
            np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= self.far
        found = (s.swapaxes(1, 2) @ kv[:, :, WIDTH:]).reshape(-1, WIDTH + 1)
        part = 1 / np.maximum(found[:, WIDTH:], s.dtype.type(1e-30))
        found = found[:, :WIDTH] * part
        x = found + own
        h = x @ self.p["up"]
        h += self.p["bias"]
        np.maximum(h, 0, out=h)
        y = h @ self.p["down"]
        y += x
        return y, (keys, q, kv, own, s, part, found, x, h, y)

    def _chunks(self, y: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first position, logits) of some positions after the others; the array is used again."""
        size = min(CHUNK, len(y))
        logits, own = np.empty((size, CLASSES), y.dtype), np.empty((size, CLASSES), self.base.dtype)
        for k in range(0, len(y), CHUNK):
            n = min(CHUNK, len(y) - k)
            np.matmul(y[k : k + n], self.p["out"], out=logits[:n])
            logits[:n] += self.base.take(asks[k : k + n], 0, out=own[:n], mode="clip")
            yield k, logits[:n]

    def _mass(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """(sum of exponentials by position, what was taken from the logits before); the logits become their exponentials, safe from overflow."""
        most = 0.0
        if logits.max() > 60 or logits[:, 0].min() < -60:
            most = logits.max(-1, keepdims=True)
            logits -= most
        np.exp(logits, out=logits)
        return logits @ self.ones, most

    def forward(self, keys: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log-probabilities of all classes, and what their gradient needs."""
        y, kept = self._seen(keys)
        logp = np.concatenate([z.copy() for _, z in self._chunks(y, keys[:, SPAN:].ravel())])
        logp -= logp.max(-1, keepdims=True)
        logp -= np.log(np.exp(logp).sum(-1, keepdims=True))
        return logp, kept

    def of(self, keys: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of the class that follows at each position; 0 for PAD."""
        y, _ = self._seen(keys)
        flat = target.ravel()
        out = np.zeros(len(y), y.dtype)
        for k, z in self._chunks(y, keys[:, SPAN:].ravel()):
            n = len(z)
            told = z.ravel().take(np.arange(n) * CLASSES + np.minimum(flat[k : k + n], CLASSES - 1))
            mass, most = self._mass(z)
            out[k : k + n] = told - np.log(mass) - np.ravel(most)
        return np.where(flat != PAD, out, 0).reshape(target.shape)

    def gradient(self, logp: np.ndarray, kept: tuple, target: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss of the positions that have a target, as one array."""
        y, flat = kept[-1], target.ravel()
        there = np.flatnonzero(flat != PAD)
        d = np.zeros_like(logp)
        d[there] = np.exp(logp[there])
        d[there, flat[there]] -= 1
        d /= max(len(there), 1)
        return self._back(d @ self.out, y.T @ d, kept)

    def learn(self, keys: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The gradient by one exponential a logit, for training."""
        y, kept = self._seen(keys)
        flat, kind = target.ravel(), y.dtype
        real = flat != PAD
        each = real / kind.type(max(int(real.sum()), 1))
        at = np.arange(len(y)) % CHUNK * CLASSES + np.minimum(flat, CLASSES - 1)
        dy, out = np.empty_like(y), np.zeros((WIDTH, CLASSES), kind)
        for k, z in self._chunks(y, keys[:, SPAN:].ravel()):
            n = len(z)
            mass, _ = self._mass(z)
            z.ravel()[at[k : k + n]] -= mass
            scale = (each[k : k + n] / mass).astype(kind)[:, None]
            out += (y[k : k + n] * scale).T @ z
            np.matmul(z, self.out, out=dy[k : k + n])
            dy[k : k + n] *= scale
        return self._back(dy, out, kept)

    def _back(self, dy: np.ndarray, out: np.ndarray, kept: tuple) -> np.ndarray:
        """All weights' gradient from that of what the layers make."""
        keys, q, kv, own, s, part, found, x, h, _ = kept
        p, g, kind = self.p, {"out": out}, self.flat.dtype
        n, rows = len(keys), lambda a: a.reshape(-1, a.shape[-1])
        g["down"], dh = h.T @ dy, dy @ p["down"].T
        dh *= h > 0
        g["up"], g["bias"] = x.T @ dh, np.ones(len(dh), kind) @ dh
        dx = dh @ p["up"].T
        dx += dy
        dfound = np.empty((n, SPAN, WIDTH + 1), kind)
        to = rows(dfound)
        np.multiply(dx, part, out=to[:, :WIDTH])
        to[:, WIDTH] = (to[:, :WIDTH] * found) @ -self.ones[:WIDTH]
        ds = kv[:, :, WIDTH:] @ np.ascontiguousarray(dfound.swapaxes(1, 2))
        ds *= s
        g["near"] = np.bincount(BACK.T.ravel(), np.ones(n, kind) @ ds.reshape(n, -1), 2 * SPAN).astype(kind)
        dq, dkv = rows(ds.swapaxes(1, 2) @ kv[:, :, :WIDTH]), np.empty((n, 2 * SPAN, 2 * WIDTH), kind)
        np.matmul(ds, q, out=dkv[:, :, :WIDTH])
        np.matmul(s, dfound[:, :, :WIDTH], out=dkv[:, :, WIDTH:])
        told = (self.embed.take(keys, 0).reshape(2, -1, WIDTH).swapaxes(1, 2) @ dkv.reshape(2, -1, 2 * WIDTH)).sum(0)  # two small products are faster than one
        g["query"] = own.T @ dq / np.sqrt(kind.type(WIDTH))
        g["key"], g["value"] = told[:, :WIDTH], told[:, WIDTH:]
        de = (rows(dkv) @ self.told.T).reshape(n, 2 * SPAN, WIDTH)
        dx += dq @ self.ask.T
        de[:, SPAN:] += dx.reshape(n, SPAN, WIDTH)
        g["embed"] = np.bincount(_SPREAD.take(keys, 0).ravel(), de.ravel(), (CLASSES + 1) * WIDTH)[: CLASSES * WIDTH].astype(kind)
        return np.concatenate([g[k].ravel() for k in shapes()])


#: Where the numbers of each class lie.
_SPREAD = np.arange((CLASSES + 1) * WIDTH).reshape(-1, WIDTH)


class Adam:
    def __init__(self, size: int, rate: float = RATE):
        self.m, self.v, self.n, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate

    def step(self, weights: np.ndarray, g: np.ndarray) -> None:
        self.n += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        weights -= self.rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.99**self.n)) + 1e-8)


def turn_of(doc_id: int | None, turns: int) -> int:
    """A number below `turns` that tells in which round, if in any, a text is trained on."""
    return zlib.crc32(str(doc_id).encode()) // FOLDS % turns


def train_texts(model: Attention, adam: Adam, seq: np.ndarray, n: np.ndarray, step: int = STEP) -> int:
    """Train on all windows of the texts, in a mixed order; the positions seen."""
    windows = Windows(seq, n)
    order = np.random.default_rng(len(windows.rows)).permutation(windows.rows)
    for k in range(0, len(order), step):
        keys, target = windows.of(order[k : k + step])
        adam.step(model.flat, model.learn(keys, target))
        model.prepare()
    return int(n.sum())


def score_texts(model: Attention, ids: np.ndarray, seq: np.ndarray, n: np.ndarray, inside: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Natural log-probability of each text: of its classes by overlapping windows, and of its ids within their classes."""
    windows = Windows(seq, n)
    row = np.zeros(len(windows.text))
    for k in range(0, len(windows.rows), batch):
        at = windows.rows[k : k + batch]
        row[at] = model.of(*windows.of(at)).sum(1)
    of = np.repeat(np.arange(len(n)), n)
    return np.bincount(windows.text, row, len(n)) + np.bincount(of, inside[ids[1:]], len(n))


# ---- classes


def grouped(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, log P(id | class)) of every id by its count: the most frequent have a class each, the others share classes of like mass; each counts once more than it came."""
    order = np.argsort(-counts, kind="stable")
    mass = counts + 1.0
    classes = np.empty(len(counts), np.int64)
    classes[order[:OWN]] = np.arange(min(OWN, len(counts)))
    rest = order[OWN:]
    so_far = np.cumsum(mass[rest]) - mass[rest] / 2
    classes[rest] = OWN + np.minimum((so_far / max(mass[rest].sum(), 1) * (CLASSES - OWN)).astype(int), CLASSES - OWN - 1)
    return classes, np.log(mass / np.bincount(classes, mass, CLASSES)[classes])


def neighbours(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of a class after another from counts of pairs, smoothed by how often the class comes at all."""
    alone = (pairs.sum(0) + 1) / (pairs.sum() + CLASSES)
    return np.log((pairs + 20 * alone[None]) / (pairs.sum(1, keepdims=True) + 20)).astype(np.float32)


# ---- Spark


def _summed(frame: DataFrame, run, size: int) -> np.ndarray:
    """Sums by place of the arrays that tasks make; as large as `size`, whatever the input."""
    rows = frame.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    out[[r["place"] for r in rows]] = [r["value"] for r in rows]
    return out


def _told(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values[at].astype(float), pa.float64())], ["place", "value"])


def _subword_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for r in batch.to_pylist():
                counts, ids, lengths = (_unpacked(r[c]).astype(np.int64) for c in ("counts", "ids", "lengths"))
                total += np.bincount(ids, np.repeat(counts, lengths), size)
                total[-1] += counts[0]
        yield _told(total)

    return run


def _pair_counts(classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            for r in batch.to_pylist():
                total += neighbour_counts(Block(_opened(r)), classes)
        yield _told(total)

    return run


def _trained(classes: np.ndarray, base: np.ndarray, weights: np.ndarray, round_: int, rounds: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, adam, seen = Attention(weights.copy(), base), Adam(len(weights)), 0
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(_opened(r))
                mine = np.array([turn_of(d, rounds * every) == round_ for d in b.doc_ids], bool) & ~b.held
                if mine.any():
                    _, seq, n = b.only(mine).texts(classes)
                    seen += train_texts(model, adam, seq, n)
        yield _told(np.append(model.flat.astype(float) * seen, seen))

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(classes: np.ndarray, inside: np.ndarray, base: np.ndarray, weights: np.ndarray, tokens: int, distinct: int):
    """One row a text, with the scores by the model and by word counts."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(weights, base)
        for batch in batches:
            for r in batch.to_pylist():
                b, known = Block(_opened(r)), _unpacked(r["known"]).astype(np.int64)
                of = np.repeat(np.arange(len(b.sizes)), b.sizes)
                sums = lambda v: np.bincount(of, v[b.places], len(b.sizes)) + v[0]  # noqa: E731, B023
                plain = sums(np.log10(known + 1)) - (b.sizes + 1) * math.log10(tokens + distinct + 1)
                scores = score_texts(model, *b.texts(classes), inside) / math.log(10)
                cols = [b.doc_ids, b.held, b.sizes + 1, sums((known > 0).astype(float)).astype(np.int64), np.full(len(b.sizes), tokens), plain, scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

    return run


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def score_documents(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, every: int = EVERY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of (doc_id, text).

    Learns from all rows whose fold by doc_id is not the held-out one; counts take every word of theirs, and the attention trains on each of them in one
    of the rounds (on one in `every`, if asked for). Null and
    blank texts have one token, their end. A null doc_id is no fold's and learned from. Rows that repeat are learned from and scored each. An empty table gives no rows;
    with nothing to learn from, all that is known is that words may come: train_tokens is 0 and the model knows ids by their number alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("row"))
    blocks = written(rows.mapInArrow(_blocks(block_bytes), _BLOCK), "blocks")
    words = blocks.agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()[0]
    parts = -(-words // min(max(words // PARTS, PART), PART_MOST))
    looked_up = blocks.select("block", "words", "counts").mapInArrow(_dealt(max(parts, 1)), _DEALT).groupBy("part").applyInArrow(_looked_up(tokenizer), _LOOKED_UP)
    answers = looked_up.groupBy("block").agg(F.collect_list(F.struct("part", "distinct", "n", "places", "known", "ids", "lengths")).alias("parts"))
    whole = blocks.select("block", "doc_ids", "sizes", "places", "counts", "tokens").join(answers, "block")
    texts = written(whole.mapInArrow(_gathered, _TEXTS), "texts")
    let_go(docs.sparkSession)
    tokens, distinct = texts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    size = _vocabulary(tokenizer) + 1
    classes, inside = grouped(_summed(texts.select("counts", "ids", "lengths"), _subword_counts(size), size))
    places = texts.select("doc_ids", "sizes", "places", "ids", "lengths")
    base = neighbours(_summed(places, _pair_counts(classes), CLASSES * CLASSES).reshape(CLASSES, CLASSES))
    weights = start_weights()
    for k in range(rounds):
        got = _summed(places, _trained(classes, base, weights, k, rounds, every), len(weights) + 1)
        if got[-1]:
            weights = (got[:-1] / got[-1]).astype(np.float32)
    return texts.select("doc_ids", "sizes", "places", "ids", "lengths", "known").mapInArrow(_scored(classes, inside, base, weights, tokens, distinct), _SCORED)


def op12_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
