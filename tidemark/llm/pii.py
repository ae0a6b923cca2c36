"""Personal data: base patterns, and terms that would still give a removed entity away.

The patterns find e-mail and IP addresses, card and phone numbers. Removing them isn't enough if a neighbouring term
tells which entity stood there, so the corpus is asked how strongly each term reveals each protected entity: their
pointwise mutual information, from document counts, over the information content of the entity. Most values stand in one
document or two, so the chance of the entity given the term is a lower confidence bound, and an entity is asked for as its value,
as its class (domain, number prefix) and as its kind. A term that reveals a share of `generalise` or more of any of them is
replaced by a general mark, one of `remove` or more is taken out. (Information-theoretic sanitisation after Sanchez and
Batet, 2016.) Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

C = F.col
#: The patterns of the contract. Possessive repeats and the guards in front keep them linear on long runs
#: of the same characters, and find the same leftmost matches.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap signs that a text can have a match at all.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
KINDS = [*PATTERNS, "term"]
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
#: Shares of disclosure; normal deviate of the one-sided bound (90%).
GENERALISE, REMOVE, Z = 0.85, 0.95, 1.2816
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string of at most 19 digits."""
    back = F.reverse(digits)
    one = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.when(i % 2 == 0, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        d = _digits(x)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: Column, kind: str) -> Column:
    """Every leftmost match as (start, rank, end, kind, value), in code points: the lengths of the parts between matches and of the matches add up to places."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        end = at + F.length(x["value"])
        span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def _check(kind: str):
    return lambda s: _passes(kind, s["value"])


def base_spans(text: Column) -> Column:
    """Spans of the four patterns that pass their checks, by start and then in the order of the kinds."""
    none = F.array().cast(_SPAN)
    kinds = []
    for kind, pattern in PATTERNS.items():
        sign = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(SIGNS[kind])
        kinds.append(F.when(sign, F.filter(spans_of(text, F.lit(pattern), kind), _check(kind))).otherwise(none))
    return F.array_sort(F.concat(*kinds))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a text's blocks, and spans that are put together at a time: work on very long texts stays in proportion to them.
BLOCK, RUN = 2048, 256


def _marked(spans: str, mark) -> Column:
    """The column `text` with mark(span) in place of each of the sorted spans; of spans that overlap, the first."""
    text, long = C("text"), F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))

    def part(start: Column, end: Column, of: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        near = F.array_join(F.slice(of, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(near, (start % BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))

    def put(of: Column):
        def step(s: Column, x: Column) -> Column:
            return F.when(x["end"] <= s["at"], s).otherwise(F.struct(F.concat(s["out"], part(s["at"], x["start"], of), mark(x)).alias("out"), x["end"].alias("at")))

        return step

    def runs(of: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            some = F.aggregate(F.slice(spans, k * RUN + 1, F.lit(RUN)), F.struct(F.lit("").alias("out"), s["at"].alias("at")), put(of))
            return F.struct(F.concat(s["out"], F.array(some["out"])).alias("out"), some["at"].alias("at"))

        start = F.struct(F.array().cast("array<string>").alias("out"), long.alias("at"))
        numbers = F.sequence(F.lit(0), F.floor(F.size(spans) / RUN).cast("int"))
        return F.aggregate(numbers, start, step, lambda s: F.concat(F.array_join(s["out"], ""), part(s["at"], F.length(text).cast("long"), of)))

    return F.transform(F.array(blocks), runs)[0]  # the blocks are made once


def term_places(known: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, row, hits): where the words of a document stand that are among its terms (doc_id, row, term, share), as spans with `gone`, whether the word is removed.

    Words are cut once and looked up by a join, so work grows with the text, however many terms there are.
    """
    text = C("text")
    words = F.arrays_zip(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("value"), F.split(text, TERM, -1).alias("gap"))
    own = terms.select(C("doc_id").alias("_id"), C("row").alias("_row"), "term", "share")
    same = C("doc_id").eqNullSafe(C("_id")) & (C("row") == C("_row"))
    with_terms = known.dropDuplicates(["doc_id", "row"]).join(own.select("_id", "_row").distinct(), same, "left_semi")
    each = with_terms.select("doc_id", "row", F.posexplode(words).alias("k", "w")).filter(C("w.value").isNotNull()).select("doc_id", "row", "k", C("w.value").alias("value"), F.length("w.gap").alias("gap"))
    end = F.sum((C("gap") + F.length("value")).cast("long")).over(Window.partitionBy("doc_id", "row").orderBy("k"))  # a document's own words
    placed = each.withColumn("end", end).join(own, same & (F.lower("value") == C("term")))
    span = F.struct((C("end") - F.length("value")).alias("start"), F.lit(KINDS.index("term")).alias("rank"), "end", F.lit("term").alias("kind"), "value", (C("share") >= REMOVE).alias("gone"))
    return placed.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(span)).alias("hits"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _levels(s: Column) -> Column:
    """Hashes of a span's value, of its class (an e-mail's domain, the first half of an IP address, the first digits of a number) and of its kind."""
    value, kind = F.lower(s["value"]), s["kind"]
    parts = F.split(value, r"\.")
    wide = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.concat_ws(".", parts[0], parts[1])).when(kind == "card", F.substring(_digits(value), 1, 6)).otherwise(F.substring(_digits(value), 1, 4))
    return F.array(F.xxhash64(F.lit("value"), kind, value), F.xxhash64(F.lit("class"), kind, wide), F.xxhash64(F.lit("kind"), kind))


def lower_bound(n: Column, of: Column) -> Column:
    """Wilson's one-sided lower confidence bound of a chance seen as n of `of`."""
    p, z = n / of, F.lit(Z)
    return (p + z * z / (2 * of) - z * F.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def pairs_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, row, key, n_e, term, n_t, information): the terms of every document in `known` with the entities (at each level) it holds.

    n_e and n_t count documents of the whole corpus, entities' own text left out. A chance of n_et / n_t can't exceed n_e / n_t, so pairs whose
    term is too common to reach GENERALISE whatever n_et is are dropped before they are counted. So are terms with n_t = 0: parts of words that
    are joined to a value (`def` in `10.0.0.1def`), whose like stands in other documents' values only, so no document has such a word to mark. Words are counted with map-side
    combine, so what is shuffled is a task's vocabulary, not its text.
    """
    total = docs.count()
    entities = known.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_e")).filter(C("n_e") < total)
    entities = cut(entities)
    reach = lambda n: F.pow(n.cast("double"), F.lit(GENERALISE)) * F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) + 1e-6
    widest = entities.agg(F.max(reach(C("n_e")))).first()[0] or 0.0
    own = known.select(F.explode(F.array_except(_terms(C("text")), "terms")).alias("term"), F.lit(-1).alias("n"))
    words = docs.select(F.explode(_terms(C("text"))).alias("term"), F.lit(1).alias("n")).unionByName(own).groupBy("term").agg(F.sum("n").alias("n_t")).filter((C("n_t") > 0) & (C("n_t") <= widest))
    common = known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(C("n") > widest).select("term")
    held = known.select(C("doc_id").alias("_id"), C("row").alias("_row"), F.explode("keys").alias("key")).distinct().join(entities, "key").groupBy("_id", "_row").agg(F.collect_list(F.struct("key", "n_e")).alias("held"))
    rows = known.join(held, C("doc_id").eqNullSafe(C("_id")) & (C("row") == C("_row"))).select("doc_id", "row", "held", F.explode("terms").alias("term"))
    rows = rows.join(F.broadcast(common), "term", "left_anti").join(words, "term")
    rows = rows.select("doc_id", "row", "term", "n_t", F.inline("held")).filter(C("n_t") <= reach(C("n_e")))
    return rows.withColumn("information", F.ln(F.lit(float(total)) / C("n_e")))


def disclosing(pairs: DataFrame) -> DataFrame:
    """(key, term, share) of the terms that reveal an entity, its class or its kind by GENERALISE of its information or more."""
    counts = pairs.groupBy("key", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_t").alias("n_t"), F.first("information").alias("information"))
    share = 1 + F.ln(lower_bound(C("n_et"), C("n_t"))) / C("information")
    return counts.select("key", "term", share.alias("share")).filter(C("share") >= GENERALISE)


def sanitise(df: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, base (spans), spans (base and terms) and clean (the text without them) of every row.

    Null texts count as empty and have no spans; rows that repeat stay and count as documents each; null keys are kept; an empty
    table gives no rows; other columns are left out, or put into the struct `carried` if `carry` names them. Where spans overlap, each leaves its mark once.
    """
    docs = df.select(C(key).cast("long").alias("doc_id"), F.coalesce(C(text), F.lit("")).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    with_it = ["carried"] if carry else []
    found = docs.select("doc_id", "text", *with_it, base_spans(C("text")).alias("base"))
    keys = F.array_distinct(F.flatten(F.transform("base", _levels)))
    known = cut(found.filter(F.size("base") > 0).withColumns({"row": F.xxhash64("text"), "keys": keys, "terms": _terms(_marked("base", lambda s: F.lit(" ")))}))
    pairs = cut(pairs_of(docs, known))
    terms = pairs.join(disclosing(pairs), ["key", "term"]).groupBy("doc_id", "row", "term").agg(F.max("share").alias("share"))
    known = known.drop("keys", "terms")
    hits = term_places(known, terms).select(C("doc_id").alias("_id"), C("row").alias("_row"), "hits")
    rows = known.join(hits, C("doc_id").eqNullSafe(C("_id")) & (C("row") == C("_row")), "left").select("doc_id", "text", *with_it, "base", "hits")
    plain = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "value")])
    hits = F.coalesce("hits", F.array())
    rows = rows.withColumn("spans", F.array_sort(F.concat("base", F.transform(hits, plain))))
    rows = rows.withColumn("_marks", F.array_sort(F.concat(F.transform("base", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "value")], F.lit(False).alias("gone"))), hits)))

    def mark(x: Column) -> Column:
        return F.when(x["kind"] != "term", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).when(x["gone"], F.lit("")).otherwise(F.lit("[TERM]"))

    rows = rows.select("doc_id", "text", *with_it, "base", "spans", _marked("_marks", mark).alias("clean"))
    none = F.array().cast(_SPAN)  # not `base` once more, which would look for its spans again
    rest = found.filter(F.size("base") == 0).select("doc_id", "text", *with_it, none.alias("base"), none.alias("spans"), C("text").alias("clean"))
    return rows.unionByName(rest)


def digest(rows: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, PATTERNS), F.sha2(joined(C("base")), 256).alias("base_sha256"), joined(C("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(sanitise(read_table(spark, sf_dir, "documents")))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pat(rank, kind, p) AS (VALUES (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (2, 'card', '[0-9](?:[ -]?[0-9])+'), (3, 'phone', '\+[0-9][ ().0-9-]+[0-9]')),
found AS (
  SELECT r, 0 AS rank, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS vs, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gs FROM d
  UNION ALL SELECT r, 1, regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT r, 2, regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), string_split_regex(t, '[0-9](?:[ -]?[0-9])+') FROM d
  UNION ALL SELECT r, 3, regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][ ().0-9-]+[0-9]') FROM d),
each AS (SELECT r, rank, unnest(range(1, len(vs) + 1)) AS k, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g FROM found),
placed AS (SELECT r, rank, v, sum(length(g) + length(v)) OVER (PARTITION BY r, rank ORDER BY k)::BIGINT AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM each),
base AS (SELECT r, rank, kind, v, digits, e - length(v) AS s, e FROM placed JOIN pat USING (rank) WHERE
  CASE rank WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse(digits), i + 1, 1)::INT ELSE substr(reverse(digits), i + 1, 1)::INT * 2 - CASE WHEN substr(reverse(digits), i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
n AS (SELECT count(*)::DOUBLE AS total FROM d),
keys AS (SELECT DISTINCT r, unnest(['v|' || kind || '|' || lower(v), 'c|' || kind || '|' || CASE rank WHEN 0 THEN regexp_extract(lower(v), '[^@]*$') WHEN 1 THEN string_split(v, '.')[1] || '.' || string_split(v, '.')[2] WHEN 2 THEN digits[1:6] ELSE digits[1:4] END, 'k|' || kind]) AS key FROM base),
ent AS (SELECT key, count(*) AS n_e, pow(count(*)::DOUBLE, 0.85) * pow(any_value(total), 0.15) + 1e-6 AS reach, ln(any_value(total) / count(*)) AS information FROM keys, n GROUP BY key HAVING count(*) < any_value(total)),
raw AS (SELECT r, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*')) AS ws FROM d),
spans AS (SELECT r, list(struct_pack(s := s, e := e)) AS ss FROM base GROUP BY r),
known AS (SELECT r, list_distinct(regexp_extract_all(lower(array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN len(list_filter(ss, lambda x: x.s < i AND i <= x.e)) > 0 THEN ' ' ELSE substr(t, i, 1) END), '')), '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*')) AS ws FROM spans JOIN d USING (r)),
kt AS (SELECT r, unnest(ws) AS term FROM known),
nt AS (SELECT term, sum(x) AS n_t FROM (SELECT unnest(ws) AS term, 1 AS x FROM raw UNION ALL SELECT * FROM (SELECT unnest(list_filter(raw.ws, lambda w: NOT list_contains(known.ws, w))) AS term, -1 AS x FROM raw JOIN known USING (r))) GROUP BY term),
pairs AS (SELECT kt.r, kt.term, keys.key, n_t::DOUBLE AS n_t, information FROM kt JOIN keys USING (r) JOIN ent USING (key) JOIN nt ON nt.term = kt.term WHERE n_t <= reach),
telling AS (SELECT key, term FROM (SELECT key, term, count(*) / any_value(n_t) AS p, any_value(n_t) AS m, any_value(information) AS information FROM pairs GROUP BY key, term)
  WHERE 1 + ln((p + 1.2816 * 1.2816 / (2 * m) - 1.2816 * sqrt(p * (1 - p) / m + 1.2816 * 1.2816 / (4 * m * m))) / (1 + 1.2816 * 1.2816 / m)) / information >= 0.85),
own AS (SELECT DISTINCT r, term FROM pairs JOIN telling USING (key, term)),
tok AS (SELECT r, unnest(range(1, len(vs) + 1)) AS k, unnest(vs) AS v, unnest(gs[1:len(vs)]) AS g FROM (SELECT r, regexp_extract_all(t, '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*') AS vs, string_split_regex(t, '[\p{L}\p{N}][\p{L}\p{M}\p{N}]*') AS gs FROM d WHERE r IN (SELECT r FROM own))),
hits AS (SELECT t.r, 4 AS rank, 'term' AS kind, e - length(v) AS s, e FROM (SELECT r, v, sum(length(g) + length(v)) OVER (PARTITION BY r ORDER BY k)::BIGINT AS e FROM tok) t JOIN own ON own.r = t.r AND own.term = lower(v)),
al AS (SELECT r, rank, kind, s, e FROM base UNION ALL SELECT * FROM hits),
o AS (SELECT r, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (rank < 4), '') AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS sp, count(*) AS n_spans FROM al GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, coalesce(sp, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN o USING (r)
"""
