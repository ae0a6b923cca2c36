"""Byte-level BPE with DuckDB's recursive queries, one database in each Python worker.

Spark deals out the texts; inside a task, the distinct pieces of some texts become rows (piece, position, token). A
recursive query joins neighbouring tokens with the merge table and contracts each piece's leftmost pair of least rank
until no piece has a pair left. Decoding joins the ids of each document with the vocabulary and puts the bytes together in an ordered
aggregate. Words met lately keep their ids, so a word goes through the database once per task or so.

One contraction a round is right for words, but a run of n letters would take n rounds of n rows. Long pieces are contracted in
many places a round. Each token has a time, the largest rank in its making, and a pair the largest of its rank and its tokens' times; the
text tells which vocabulary tokens could reach over a pair's ends. If none that reaches into the pair from the left, or out of it to the right, has a
rank up to the pair's time, nothing that is contracted earlier can touch the pair, so it may go at once. The tokens that a
long piece holds are looked up once. A piece that no pair is proven for goes through the plain query.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, give_back, read_table, slices

#: Bytes that the pieces and words kept in a task may take.
_MEMO_BYTES = 80 << 20
#: Token rows that go through one query; more are cut between pieces or documents.
_ROWS = 400_000
#: Bytes from which a piece counts as long.
LONG = 200

#: `start` has a row (piece, pos, tok) for each byte, pos counting through all pieces, and a row with token -1 behind each piece.
ENCODE_SQL = """
WITH RECURSIVE state(piece, pos, tok, done) AS (
  SELECT piece, pos, tok, false FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT piece, pos, tok, lead(tok) OVER w AS after, lag(pos) OVER w AS before FROM state WHERE NOT done WINDOW w AS (ORDER BY pos)),
  least AS (SELECT p.piece, min((m.merged::BIGINT << 32) | p.pos) AS best FROM pairs p JOIN merges m ON m.l = p.tok AND m.r = p.after GROUP BY p.piece)
  SELECT p.piece, p.pos, CASE WHEN p.pos = best & 4294967295 THEN (best >> 32)::INTEGER ELSE p.tok END, best IS NULL
  FROM pairs p LEFT JOIN least b ON b.piece = p.piece
  WHERE best IS NULL OR before IS NULL OR before <> best & 4294967295)
)
SELECT piece, list(tok ORDER BY pos) AS ids FROM state WHERE done AND tok >= 0 GROUP BY piece ORDER BY piece
"""
#: `held` has a row (s, e, rank) for each place where a piece spells a vocabulary token of two bytes or more, from position s up to e.
#: In a run of equal tokens every other pair may go, the leftmost first, as far as no pair before it has to wait.
LONG_SQL = """
WITH RECURSIVE state(piece, pos, tok, t, done) AS (
  SELECT piece, pos, tok, -1, 0 FROM start
  UNION ALL
  (WITH rows AS MATERIALIZED (
    SELECT piece, pos, tok, t, lead(tok) OVER w AS ntok, lead(t) OVER w AS nt, lead(pos) OVER w AS m, lead(pos, 2) OVER w AS e, lag(pos) OVER w AS before,
      sum(CASE WHEN tok = before_tok THEN 0 ELSE 1 END) OVER w AS run
    FROM (SELECT *, lag(tok) OVER (ORDER BY pos) AS before_tok FROM state WHERE done = 0) WINDOW w AS (ORDER BY pos)),
  numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS idx FROM rows),
  pairs AS MATERIALIZED (
    SELECT p.piece, p.pos, p.m, p.e, p.before, p.run, p.idx, p.tok = p.ntok AS same, x.merged AS r, greatest(x.merged, p.t, p.nt) AS tau
    FROM numbered p JOIN merges x ON x.l = p.tok AND x.r = p.ntok),
  waiting AS MATERIALIZED (
    SELECT c.pos, c.run, c.idx, c.same FROM pairs c JOIN held h ON h.e = c.m JOIN rows a ON a.pos = h.s
    WHERE h.s < c.pos AND h.rank <= c.tau AND NOT (c.same AND c.idx > 0 AND c.idx % 2 = 0 AND h.rank = c.r AND h.s = c.before)
    UNION
    SELECT c.pos, c.run, c.idx, c.same FROM pairs c JOIN held h ON h.s = c.m JOIN rows a ON a.pos = h.e
    WHERE h.e > c.e AND h.rank <= c.tau AND NOT (h.rank = c.r AND c.tau = c.r)),
  blocked AS (SELECT run, min(idx) AS idx FROM waiting WHERE same AND idx % 2 = 0 GROUP BY run),
  sure AS MATERIALIZED (
    SELECT c.piece, c.pos, c.m, c.r, c.tau FROM pairs c LEFT JOIN blocked b ON b.run = c.run
    WHERE c.pos NOT IN (SELECT pos FROM waiting) AND NOT (c.same AND (c.idx % 2 = 1 OR coalesce(b.idx <= c.idx, false)))),
  ends AS (SELECT p.piece, CASE WHEN count(s.piece) = 0 THEN 2 ELSE 0 END AS done FROM (SELECT DISTINCT piece FROM pairs) p LEFT JOIN (SELECT DISTINCT piece FROM sure) s ON s.piece = p.piece GROUP BY p.piece)
  SELECT p.piece, p.pos, coalesce(s.r, p.tok), coalesce(s.tau, p.t), coalesce(x.done, 1)
  FROM rows p LEFT JOIN sure s ON s.pos = p.pos LEFT JOIN ends x ON x.piece = p.piece
  WHERE p.pos NOT IN (SELECT m FROM sure))
)
SELECT piece, CASE WHEN max(done) = 1 THEN list(tok ORDER BY pos) END AS ids FROM state WHERE done > 0 AND tok >= 0 GROUP BY piece ORDER BY piece
"""
DECODE_SQL = "SELECT doc, list(v.bytes ORDER BY pos) AS parts FROM ids JOIN vocabulary v ON v.id = ids.tok GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=1)
def _database(path: str):
    """A DuckDB connection with the merge table (every way to part a token into two) and the vocabulary, and the ranks."""
    import duckdb

    ranks = read_ranks(path)
    rows = [(ranks[t[:k]], ranks[t[k:]], i) for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right, merged = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
    con.register("m", pa.table({"l": left, "r": right, "merged": merged}))
    con.execute("CREATE TABLE merges AS SELECT * FROM m")
    con.register("v", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}))
    con.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
    con.unregister("m")
    con.unregister("v")
    return con, ranks


class Pieces:
    """Ids of texts by their words; the ids of new pieces come from the database in bulk.

    A word is what stands between spaces, with the space before it. No match of the pattern reaches over a single space into the word
    before, so the ids of a text whose words stand between single spaces and line ends are those of its words. Texts with other
    white space, or runs of it, are parted by the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str, memo_bytes: int = _MEMO_BYTES, long: int = LONG):
        import regex

        self.con, self.ranks = _database(path)
        self.long, self.begins = long, set()
        self.split = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.memo = Memo(memo_bytes)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Words of a text as keys of the memo; none if white space stands in runs or at an edge.

        A plain key is a word with a space before it; behind \\x00 and \\n it is one at the begin of a line, with the line end before it, and behind
        \\x00 and \\x01 one without anything before it.
        """
        if "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or "\x00" in text or text[:1] in " \n" or text[-1:] == " " or text[-2:] == "\n\n":
            return []
        return ("\x00\x01" + text.replace("\n", " \x00\n")).split(" ")

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern as keys: those of white space alone behind two \\x00, others as words."""
        return ["\x00\x00" + p if p.isspace() else p[1:] if p[0] == " " else "\x00\x01" + p for p in self.split(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts))
        memo, out, odd = self.memo.new, [], {}
        for k, x in enumerate(parts):
            try:
                out.append(b"".join([memo[p] for p in x]))
            except TypeError:  # a word with white space of another kind at an edge
                x = []
                out.append(b"")
            if not x and texts[k]:
                odd[k] = self.pieces(texts[k])
        self.learn_pieces(set().union(*odd.values()))
        for k, x in odd.items():
            out[k] = b"".join([memo[p] for p in x])
        return out

    def learn(self, words: set[str]) -> None:
        """Afterwards `self.memo.new` has the ids of all `words`, and "" for those that have white space at an edge."""
        self.memo.turn(words)
        memo = self.memo.new
        # A space and ASCII letters are one piece, whose ids are the word's.
        whole: set[str] = set()
        mixed: dict[str, list[str] | tuple] = {}
        for w in words.difference(memo):
            if w.isalpha() and w.isascii():
                whole.add(w)
                continue
            core = w[2:] if w[0] == "\x00" else w
            text = " " + w if core is w else core if w[1] == "\x01" else w[1:]
            mixed[w] = () if core and (core[0].isspace() or core[-1].isspace()) else self.pieces(text)
        self.learn_pieces(whole.union(*mixed.values()))
        self.memo.update(list(mixed), [b"".join([memo[p] for p in x]) if x else "" for x in mixed.values()])

    def learn_pieces(self, pieces: set[str]) -> None:
        self.memo.recall(pieces)
        memo = self.memo.new
        known: list[str] = []
        ids: list[bytes] = []
        parts: list[list[tuple[str, bytes]]] = [[], []]
        size = [0, 0]
        for p in pieces.difference(memo):
            data = p[2:].encode() if p[0] == "\x00" else b" " + p.encode()
            if (whole := self.ranks.get(data)) is not None:
                known.append(p)
                ids.append(whole.to_bytes(4, "little"))
                continue
            long = len(data) >= self.long
            parts[long].append((p, data))
            size[long] += len(data)
            if size[long] > _ROWS:
                self._contract(parts[long], long)
                parts[long], size[long] = [], 0
        self.memo.update(known, ids)
        for long, part in enumerate(parts):
            if part:
                self._contract(part, bool(long))

    def _held(self, data: bytes, at: int) -> list[tuple[int, int, int]]:
        """(s, e, rank) of every vocabulary token of two bytes or more that a piece at position `at` spells."""
        if not self.begins:
            self.begins.update(t[:k] for t in self.ranks for k in range(2, len(t) + 1))
        out, begins, ranks = [], self.begins, self.ranks
        for s in range(len(data) - 1):
            e = s + 2
            while e <= len(data) and (part := data[s:e]) in begins:
                if (rank := ranks.get(part)) is not None:
                    out.append((at + s, at + e, rank))
                e += 1
        return out

    def _contract(self, part: list[tuple[str, bytes]], long: bool = False) -> None:
        size = np.array([len(d) + 1 for _, d in part], np.int64)
        tok = np.full(int(size.sum()), -1, np.int32)
        inside = np.ones(len(tok), bool)
        inside[np.cumsum(size) - 1] = False
        tok[inside] = self.bytes[np.frombuffer(b"".join(d for _, d in part), np.uint8)]
        self.con.register("start", pa.table({"piece": np.repeat(np.arange(len(part), dtype=np.int32), size), "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
        if long:
            held = [x for (_, d), at in zip(part, (np.cumsum(size) - size).tolist(), strict=True) for x in self._held(d, at)]
            self.con.register("held", pa.table({n: pa.array([x[k] for x in held], pa.int32()) for k, n in enumerate(("s", "e", "rank"))}))
        found = self.con.sql(LONG_SQL if long else ENCODE_SQL).to_arrow_table().column(1).combine_chunks()
        self.con.unregister("start")
        if long:
            self.con.unregister("held")
            if found.null_count:
                self._contract([x for x, ids in zip(part, found.is_null().to_pylist(), strict=True) if ids])
            part = [x for x, ids in zip(part, found.is_null().to_pylist(), strict=True) if not ids]
            found = found.drop_null()
        flat, ends = found.flatten().to_numpy().astype(np.int32).tobytes(), (found.offsets.to_numpy() * 4).tolist()
        self.memo.update([p for p, _ in part], [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _encoded(path: str, pattern: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces(path, pattern)
        for batch in slices(batches, 1):
            columns = [batch.column(0), _lists(known.encode([t or "" for t in batch.column(1).to_pylist()]))]
            if back:
                columns.append(decoded(known.con, columns[1]))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def encode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): byte-level BPE ids of every text, each match of `pattern` by itself, without special tokens.

    Null and empty texts have no ids; rows that repeat stay; null keys are kept; an empty table gives no rows; other columns are
    left out.
    """
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoded(ranks_path, pattern, False), "doc_id long, ids array<int>")


def decoded(con, ids: pa.ListArray) -> pa.Array:
    """The bytes of each list of ids: the vocabulary's bytes in the order of the ids' places, from the database; null lists have none."""
    sizes, tok, at, out = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), 0, []
    ends = np.cumsum(sizes)
    while at < len(ids):
        before = int(ends[at - 1]) if at else 0
        n = max(1, int(np.searchsorted(ends, before + _ROWS, side="right")) - at)
        part, last = sizes[at : at + n], int(ends[at + n - 1])
        texts = [b""] * n
        if last > before:
            con.register("ids", pa.table({"doc": np.repeat(np.arange(n, dtype=np.int32), part), "pos": np.arange(last - before, dtype=np.int32), "tok": tok[before:last]}))
            found = con.sql(DECODE_SQL).to_arrow_table()
            con.unregister("ids")
            parts = found.column(1).combine_chunks()
            for doc, data in zip(found.column(0).to_pylist(), pc.binary_join(parts, pa.scalar(b"", parts.type.value_type)).to_pylist(), strict=True):
                texts[doc] = data
        out += texts
        at += n
    return pa.array(out, pa.binary())


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, _ = _database(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = pa.array([x or [] for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, decoded(con, lists)], [*batch.schema.names, "decoded"])
        give_back()

    return run


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of (doc_id, ids) with `decoded`, the bytes of the ids; null ids decode to no bytes."""
    return df.select("doc_id", "ids").mapInArrow(_decoded(ranks_path), "doc_id long, ids array<int>, decoded binary")


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`encode`, and `decode` of each document's ids, in one pass over one database in a task."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encoded(ranks_path, pattern, True), "doc_id long, ids array<int>, decoded binary")


def op9_duckdb_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = encode_and_decode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
