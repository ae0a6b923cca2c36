"""Repair of conversation structure by iterative-deepening A*.

A conversation is sound if its rows' roles read `(s?(ua)+)?` by their initials. Rows are kept, given the role that is due, deleted or
joined by an inserted empty row, and the cheapest edits are found by depth-first search in ASCII edit order (Delete, Insert, Keep, Rerole) under
a cost bound that grows to the least cost that went beyond it. A table of failed states (row, state of the pattern) holds the most that
was left to spend when each failed, so it is searched again only with more. The heuristic counts deletions and truncations still to be paid and a
matching of neighbours that don't go together. The first path that is accepted is the cheapest, and among equals the ASCII-least.

Rows are sorted by range over conversation and turn, so a long conversation lies in several tasks. Searches take runs of at most RUN
rows, from every state to every state; a conversation's runs are joined by their costs from the back, and from the front by
the least text among the cheapest, which is exact since no run's edits are the beginning of another's for the same rows. What needs its rows in one
place takes summaries of CHUNK rows each; texts pass through a task one chunk after the other.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, read_table

#: Rows in one search, in one chunk of a long conversation, and bytes of its texts after which a chunk ends.
RUN, CHUNK, CHUNK_BYTES = 16, 256, 1 << 20
#: Characters by which rows of one turn are put in order before their digests are.
ORDERED = 64
INF = 1 << 60
#: States of the pattern: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: The state after the role that is due, and edits that end a conversation from each state.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDING = {START: (0, ""), SYSTEM: (6, "II"), USER: (3, "I"), ASSISTANT: (0, "")}
ROLE = {USER: "user", ASSISTANT: "assistant"}
_WORD = re.compile(r"[^\x20\x09-\x0D]").search
_ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z").search


# ---- the search


def estimate(rows: str) -> list[int]:
    """For each place in `rows`, a lower bound of what the rows from there on cost in any state.

    A row is a letter: its role's initial (x for any other), upper case if truncated, or d if it has to be deleted. Each d costs 4, each truncated row 3
    at least. Beyond that an x, and two neighbours that don't go together once d's are out, need an edit of 3 (or 1, a truncated
    row's deletion over its 3); pairs of a matching don't share edits.
    """
    n = len(rows)
    paid, extra = [0] * (n + 1), [0] * (n + 1)
    after = n  # the next row that is no d
    for i in range(n - 1, -1, -1):
        c = rows[i]
        paid[i] = paid[i + 1] + (4 if c == "d" else 3 if c.isupper() else 0)
        extra[i] = extra[i + 1]
        if c != "d":
            own = 1 if c.isupper() else 3
            if c in "xX":
                extra[i] += own
            elif after < n and rows[after] not in "xX" and (c + rows[after]).lower() not in ("su", "ua", "au"):
                extra[i] = max(extra[i], min(own, 1 if rows[after].isupper() else 3) + extra[after + 1])
            after = i
    return [a + b for a, b in zip(paid, extra, strict=True)]


@functools.lru_cache(maxsize=200_000)
def search(rows: str, entry: int, leave: int | None = None) -> tuple[int, str]:
    """(cost, edits) of the cheapest, ASCII-least way through `rows` from state `entry` to an accepted end, or to state `leave` with an edit of a row last; (INF, "") if there is none."""
    if leave is not None and (leave == START != entry or leave == SYSTEM and entry in (USER, ASSISTANT) or leave == SYSTEM and entry == START and not set(rows) & set("sS") or not rows and leave != entry):
        return INF, ""
    n, ahead = len(rows), estimate(rows)
    bound = ahead[0]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = INF

        def visit(i: int, state: int, spent: int) -> str | None:
            nonlocal beyond
            if spent + ahead[i] > bound:
                beyond = min(beyond, spent + ahead[i])
                return None
            if i == n and (state == leave if leave is not None else not ENDING[state][0]):
                return ""
            if i == n and leave is not None or failed.get((i, state), -1) >= bound - spent:
                return None
            c = rows[i] if i < n else ""
            if c and (rest := visit(i + 1, state, spent + 4)) is not None:
                return "D" + rest
            if (rest := visit(i, DUE[state], spent + 3)) is not None:
                return "I" + rest
            if c and c != "d":
                kept = KEPT[c.lower()].get(state)
                late = 3 if c.isupper() else 0
                if kept is not None and (rest := visit(i + 1, kept, spent + late)) is not None:
                    return "K" + rest
                if (rest := visit(i + 1, DUE[state], spent + 3 + late)) is not None:
                    return "R" + rest
            failed[i, state] = bound - spent
            return None

        found = visit(0, entry, 0)
        if found is not None:
            return bound, found
        bound = beyond


def joined(costs: Sequence[Sequence[Sequence[int]]], edits: Sequence[Sequence[Sequence[str]]], entry: int, ends: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost through consecutive runs from `entry`, `ends` being what each last state costs; and each run's first and last state on the ASCII-least such way."""
    left = [list(ends)]
    for run in reversed(costs):
        left.append([min(run[a][b] + left[-1][b] for b in STATES) for a in STATES])
    left.reverse()
    way, state = [], entry
    for run, texts, now, then in zip(costs, edits, left, left[1:], strict=False):
        nxt = min((b for b in STATES if run[state][b] + then[b] == now[state]), key=lambda b: texts[state][b])
        way.append((state, nxt))
        state = nxt
    return left[0][entry], way


def matrix(rows: str) -> tuple[list[list[int]], list[list[str]]]:
    """Costs and edits through `rows` from each state to each."""
    runs = [rows[i : i + RUN] for i in range(0, len(rows), RUN)] or [""]
    costs, edits = ([[[search(run, a, b)[k] for b in STATES] for a in STATES] for run in runs] for k in (0, 1))
    if len(runs) == 1:
        return costs[0], edits[0]
    total, texts = [[INF] * 4 for _ in STATES], [[""] * 4 for _ in STATES]
    for a in STATES:
        for b in STATES:
            cost, way = joined(costs, edits, a, [0 if c == b else INF for c in STATES])
            if cost < INF:
                total[a][b], texts[a][b] = cost, "".join(e[p][q] for e, (p, q) in zip(edits, way, strict=True))
    return total, texts


def cheapest(rows: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(rows) <= RUN:
        return search(rows, START)
    runs = [rows[i : i + RUN] for i in range(0, len(rows), RUN)]
    costs, edits = ([[[search(run, a, b)[k] for b in STATES] for a in STATES] for run in runs] for k in (0, 1))
    cost, way = joined(costs, edits, START, [ENDING[q][0] for q in STATES])
    return cost, "".join(e[p][q] for e, (p, q) in zip(edits, way, strict=True)) + ENDING[way[-1][1]][1]


def repaired(rows: Sequence[tuple[str, str]], edits: str, state: int = START) -> list[str]:
    """`role:text` of the rows that the edits leave or make, from a state of the pattern."""
    out, at = [], 0
    for e in edits:
        role, text = rows[at] if e != "I" else ("", "")
        at += e != "I"
        if e == "D":
            continue
        state = KEPT[role[0]][state] if e == "K" else DUE[state]
        out.append(f"{role if e == 'K' else ROLE[state]}:{text}")
    return out


def faults(rows: Sequence[tuple[str, str]], before: frozenset | set = frozenset()) -> tuple[str, list[int]]:
    """The rows as letters for the search, and how many are blank, duplicate and truncated; `before` has the digests of rows that stood earlier."""
    seen, letters, counts = set(before), [], [0, 0, 0]
    for role, text in rows:
        key = digest(role, text)
        again = key in seen
        seen.add(key)
        c = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not _WORD(text):
            kind, c = 0, "d"
        elif again:
            kind, c = 1, "d"
        elif not _ENDED(text):
            kind, c = 2, c.upper()
        else:
            kind = None
        if kind is not None:
            counts[kind] += 1
        letters.append(c)
    return "".join(letters), counts


def digest(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


# ---- Spark


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): every row as the checksum of `conv_id:turn` damages it, how often it then stands there (0 if dropped); nulls are one space, in role and text and in what is summed up."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("_k"))
    k, text = F.col("_k"), F.col("text")
    return rows.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(k.isin(0, 1), F.lit("")).when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = "open boolean, part int, seq long, rows array<struct<turn:long,role:string,text:string>>"


def _arrow(schema: str) -> pa.Schema:
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds.get(kind, pa.list_(row))) for name, kind in (f.strip().split(" ", 1) for f in re.split(r", (?=\w+ )", schema))])


def _turns(turns: Sequence[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _whole(conv_id: int | None, rows: list[tuple]) -> dict:
    pairs = [(role, text) for _, role, text in rows]
    letters, (blank, duplicate, truncated) = faults(pairs)
    cost, edits = cheapest(letters)
    first, last, distinct = _turns([t for t, _, _ in rows])
    sha = hashlib.sha256("\n".join(repaired(pairs, edits)).encode()).hexdigest()
    return {
        "conv_id": conv_id, "gaps": last - first + 1 - distinct if distinct else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated,
        "illegal": illegal([role[:1] for role, _ in pairs]), "cost": cost, "audit": edits, "repaired_sha256": sha, "open": False,
    }


def _gathered(run_schema: str):
    """Sorted rows as finished conversations, or, of those that are long or lie at an edge of the task's range, as chunks of their rows."""
    schema = _arrow(run_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        part = conv = None
        held, size, seq, edge = [], 0, 0, True

        def chunk() -> None:
            nonlocal held, size, seq
            out.append({"conv_id": conv, "open": True, "part": part, "seq": seq, "rows": [{"turn": t, "role": r, "text": x} for t, r, x in held]})
            held, size, seq = [], 0, seq + 1

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for at, c, turn, role, text, copies in zip(*columns, strict=True):
                if part is None:
                    part, conv = at, c
                elif c != conv:
                    if edge or seq:
                        chunk()
                    else:
                        out.append(_whole(conv, held))
                    conv, held, size, seq, edge = c, [], 0, 0, False
                for _ in range(copies):
                    if len(held) == CHUNK or size > CHUNK_BYTES:
                        chunk()
                    held.append((turn, role, text))
                    size += len(text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if part is not None:
            chunk()
            yield pa.RecordBatch.from_pylist(out, schema)
        give_back()

    return run


_SUMMARY = "conv string, part int, seq long, costs array<long>, ranks array<long>, blank long, duplicate long, truncated long, illegal long, initials string, size long, first long, last long, turns long"
_TEXTS = "edits array<string>"


def _summed(run_schema: str):
    """Chunks as costs and edits from each state to each, and counts."""
    schema = _arrow(run_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pairs = [(x["role"], x["text"]) for x in r["rows"]]
                letters, (blank, duplicate, truncated) = faults(pairs, set(r["before"] or ()))
                costs, edits = matrix(letters)
                ranks = [sorted(texts).index(t) for texts in edits for t in texts]
                first, last, turns = _turns([x["turn"] for x in r["rows"]])
                initials = [role[:1] for role, _ in pairs]
                row = {
                    "conv": r["conv"], "part": r["part"], "seq": r["seq"], "costs": sum(costs, []), "ranks": ranks, "blank": blank, "duplicate": duplicate, "truncated": truncated,
                    "illegal": illegal(initials), "initials": (initials[0] or " ") + (initials[-1] or " ") if pairs else "", "size": len(pairs), "first": first, "last": last, "turns": turns, "edits": sum(edits, []),
                }
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


_WAY = "conv string, part int, seq long, entry int, leave int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _scanned(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at each chunk of a conversation; its counts stand with each. Ranks of edits take the place of their texts."""
    pdf = pdf.sort_values(["part", "seq"])
    square = lambda flat: [list(map(int, flat[4 * a : 4 * a + 4])) for a in STATES]
    costs, ranks = [square(x) for x in pdf["costs"]], [square(x) for x in pdf["ranks"]]
    cost, way = joined(costs, ranks, START, [ENDING[q][0] for q in STATES])
    edges = "".join(pdf["initials"])[1:-1]
    broken = int(pdf["illegal"].sum()) + sum(edges[i : i + 2] not in ("su", "ua", "au") for i in range(0, len(edges), 2))
    known = pdf[pdf["turns"] > 0]
    distinct = int(known["turns"].sum()) - int((known["first"].to_numpy()[1:] == known["last"].to_numpy()[:-1]).sum())
    gaps = int(known["last"].iloc[-1] - known["first"].iloc[0]) + 1 - distinct if distinct else 0
    out = pdf[["conv", "part", "seq"]].assign(entry=[a for a, _ in way], leave=[b for _, b in way], gaps=gaps, illegal=broken, cost=cost)
    for c in ("blank", "duplicate", "truncated"):
        out[c] = int(pdf[c].sum())
    return out[["conv", "part", "seq", "entry", "leave", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]]


def _told(run_schema: str):
    """Chunks in order as whole conversations: their edits put together, the repaired rows hashed as they pass."""
    schema = _arrow(run_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, head, edits, sha, filled, leave = None, {}, [], hashlib.sha256(), False, START

        def add(rows: list[str]) -> None:
            nonlocal filled
            for row in rows:
                sha.update((("\n" if filled else "") + row).encode())
                filled = True

        def ended() -> pa.RecordBatch:
            tail = ENDING[leave][1]
            edits.append(tail)
            add(repaired([], tail, leave))
            return pa.RecordBatch.from_pylist([head | {"audit": "".join(edits), "repaired_sha256": sha.hexdigest()}], schema)

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv"] != conv:
                    if conv is not None:
                        yield ended()
                    conv, edits, sha, filled = r["conv"], [], hashlib.sha256(), False
                    head = {k: r[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
                text, leave = r["edits"][4 * r["entry"] + r["leave"]], r["leave"]
                edits.append(text)
                add(repaired([(x["role"], x["text"]) for x in r["rows"]], text, r["entry"]))
        if conv is not None:
            yield ended()
        give_back()

    return run


def _earlier(chunks: DataFrame) -> DataFrame:
    """(conv, part, seq, before): digests of a chunk's rows that a chunk before it holds too. Rows of one chunk count once, so a row that repeats all over a conversation comes once in CHUNK rows."""
    row = F.col("r")
    key = F.md5(F.concat(F.length(row["role"]).cast("string"), F.lit(":"), row["role"], row["text"]).cast("binary"))
    rows = chunks.select("conv", "part", "seq", F.explode("rows").alias("r")).select("conv", "part", "seq", key.alias("digest")).distinct()
    firsts = rows.groupBy("conv", "digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = rows.join(firsts, ["conv", "digest"]).filter(F.struct("part", "seq") != F.col("first"))
    return later.groupBy("conv", "part", "seq").agg(F.collect_list("digest").alias("before"))


def repair(rows: DataFrame) -> DataFrame:
    """One row for every conversation of (conv_id, turn, role, text, copies): faults, cost and edits of the cheapest repair, the repaired rows' hash.

    Rows come in the order of turns, nulls first, then of roles, the first 64 characters of texts and their digests. A row with copies 0 makes its conversation known
    and is no part of it; a conversation of such rows only has zeros, no edits and the hash of nothing. A null conv_id is a conversation too. Only the
    initial of a role counts, and a role other than system, user or assistant by its initial, the empty one too, can't be kept. An empty table gives no rows.
    """
    order: list[Column] = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, ORDERED), F.md5(F.col("text").cast("binary")), F.monotonically_increasing_id()]
    keyed = rows.select("conv_id", "turn", "role", "text", "copies", *[c.alias(f"_{i}") for i, c in enumerate(order)])
    names = [f"_{i}" for i in range(len(order))]
    ranged = keyed.repartitionByRange(*names).sortWithinPartitions(*names)
    gathered = cut(ranged.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "copies").mapInArrow(_gathered(f"{_RESULT}, {_CHUNK}"), f"{_RESULT}, {_CHUNK}"))
    result = [f.split()[0] for f in _RESULT.split(", ")]
    chunks = gathered.filter("open").select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "part", "seq", "rows")
    place = ["conv", "part", "seq"]
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism  # chunks are few bytes and much work
    given = chunks.join(_earlier(chunks), place, "left").select(*place, "rows", "before").repartition(tasks, *place)
    summed = cut(given.mapInArrow(_summed(f"{_SUMMARY}, {_TEXTS}"), f"{_SUMMARY}, {_TEXTS}"))
    ways = summed.drop("edits").groupBy("conv").applyInPandas(_scanned, _WAY)
    told = chunks.join(summed.select(*place, "edits"), place).join(ways, place).repartition("conv").sortWithinPartitions(*place)
    whole = told.mapInArrow(_told(_RESULT), _RESULT)
    return gathered.filter("not open").select(*result).unionByName(whole)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


OP11_SQL = r"""
WITH RECURSIVE tbl AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS k
      FROM conversations, tbl),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
        CASE WHEN role[1:1] || lead(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) IN ('su', 'ua', 'au') THEN 0 WHEN lead(i) OVER (PARTITION BY conv_id ORDER BY i) IS NULL THEN 0 ELSE 1 END AS broken FROM n),
ins(q, pre, nq, price, made) AS (VALUES (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''), (0, 'I', 2, 3, E'user:\n'), (1, 'I', 2, 3, E'user:\n'), (3, 'I', 2, 3, E'user:\n'),
  (2, 'I', 3, 3, E'assistant:\n'), (0, 'II', 3, 6, E'user:\nassistant:\n'), (1, 'II', 3, 6, E'user:\nassistant:\n')),
steps(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'made': ''} FROM conversations
  UNION ALL
  SELECT conv_id, i, nq, min({'cost': cost, 'audit': audit, 'made': made}) FROM (
    SELECT s.conv_id, f.i, CASE o.op WHEN 'D' THEN ins.nq WHEN 'K' THEN CASE f.role[1:1] WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE WHEN ins.nq = 2 THEN 3 ELSE 2 END END AS nq,
      s.best.cost + ins.price + CASE o.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN f.fault = 't' AND o.op <> 'D' THEN 3 ELSE 0 END AS cost,
      s.best.audit || ins.pre || o.op AS audit,
      s.best.made || ins.made || CASE o.op WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || E'\n' ELSE CASE WHEN ins.nq = 2 THEN 'assistant:' ELSE 'user:' END || f.text || E'\n' END AS made
    FROM steps s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1 JOIN ins ON ins.q = s.q CROSS JOIN (VALUES ('D'), ('K'), ('R')) o(op)
    WHERE o.op = 'D' OR f.fault NOT IN ('b', 'd') AND (o.op = 'R' OR f.role[1:1] = 's' AND ins.nq = 0 OR f.role[1:1] = 'u' AND ins.nq <> 2 OR f.role[1:1] = 'a' AND ins.nq = 2))
  GROUP BY conv_id, i, nq),
g AS (SELECT a.conv_id, coalesce(max(f.i), 0) AS n, count(f.i) FILTER (fault = 'b') AS blank, count(f.i) FILTER (fault = 'd') AS duplicate, count(f.i) FILTER (fault = 't') AS truncated, coalesce(sum(broken), 0)::BIGINT AS illegal,
        coalesce(max(f.turn) - min(f.turn) + 1 - count(DISTINCT f.turn), 0)::BIGINT AS gaps
      FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id GROUP BY a.conv_id),
e AS (SELECT s.conv_id, min({'cost': s.best.cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': s.best.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
        'made': s.best.made || CASE q WHEN 1 THEN E'user:\nassistant:\n' WHEN 2 THEN E'assistant:\n' ELSE '' END}) AS best
      FROM steps s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.n = s.i GROUP BY s.conv_id)
SELECT g.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit, sha256(CASE WHEN best.made = '' THEN '' ELSE left(best.made, length(best.made) - 1) END) AS repaired_sha256
FROM g JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""
