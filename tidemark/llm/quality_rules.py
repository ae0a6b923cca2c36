"""Quality rules as a bitmask ledger.

Each rule is evaluated once and leaves one bit in `fail_bits`, next to the measurements it used. Policies are masks
over those bits, kept by version, so a new policy or an ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table, words_of

SYMBOLS = "#*$%&|<>"
C = F.col



def _rules() -> list[tuple[str, Column]]:
    return [
        ("few_words", C("n_words") < 50),
        ("repeated_words", 100 * C("n_repeat_words") > 50 * C("n_words")),
        ("many_symbols", 10 * C("n_symbols") > 3 * C("n_words")),
        ("duplicate_lines", 10 * C("n_dup_lines") > 5 * C("n_lines")),
        ("word_length", (C("word_chars") > 20 * C("n_words")) | (C("word_chars") < 2 * C("n_words"))),
        ("upper_case", 2 * C("n_upper") > C("word_chars")),
    ]


RULE_NAMES = ["few_words", "repeated_words", "many_symbols", "duplicate_lines", "word_length", "upper_case"]


def mask_of(*names: str) -> int:
    return sum(1 << RULE_NAMES.index(n) for n in names)


#: Policies by version; a document is kept if none of the policy's rules failed.
POLICIES = {"v1": mask_of("few_words", "repeated_words"), "v2": mask_of(*RULE_NAMES)}


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row of measurements for each row of `df`, in one pass and without a shuffle.

    n_repeat_words counts the words inside 3-word windows that occur twice or more. Windows are compared by 64-bit hash:
    most texts repeat none, which one distinct count shows; the rest sort (hash, position) pairs within the row.
    Null and empty texts measure 0 everywhere; repeated rows stay; other columns are left out, or put into the struct `row`
    if `carry` names them.
    """
    t = F.coalesce(C(text), F.lit(""))
    rows = df.select(
        C(key).alias("doc_id"),
        *([F.struct(*carry).alias("row")] if carry else []),
        words_of(t).alias("_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_lines"),
    )
    empty = F.array().cast("array<bigint>")
    w = C("_words")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    rows = rows.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 3, windows).otherwise(empty).alias("_windows"),
    ).drop("_words", "_lines")
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs).otherwise(none)).drop("_windows")
    s, n = C("_sorted"), F.size("_sorted")
    same = lambda k, other: F.get(s, other)["h"] == s[k]["h"]  # noqa: E731  get() gives null outside the array
    repeated = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda k: F.array(s[k]["i"], s[k]["i"] + 1, s[k]["i"] + 2)))))
    # The row number, always 0 or more, makes the value one that filters above can't be pushed through: pushed down, they would
    # make Spark put the expressions of the arrays into their own lambdas.
    return rows.withColumn("n_repeat_words", F.when((n > 0) & (F.monotonically_increasing_id() >= 0), covered).otherwise(F.lit(0)).cast("long")).drop("_sorted")


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Measurements and `fail_bits`: bit k is set if rule k of RULE_NAMES failed."""
    bits = [F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(_rules())]
    return measure(df, key, text, carry).withColumn("fail_bits", reduce(lambda a, b: a + b, bits).cast("int"))


def apply_policy(rows: DataFrame, mask: int) -> DataFrame:
    """`kept` under a policy, from a ledger alone."""
    return rows.withColumn("kept", C("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, mask: int) -> DataFrame:
    """For each rule of the policy: documents it fails, and those that only it fails (kept if the rule were dropped).

    The ledger shrinks to a count per bit pattern first, at most 2 ** rules rows, whatever the number of documents.
    """
    patterns = rows.groupBy(C("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).alias("bit")) for k, name in enumerate(RULE_NAMES) if mask >> k & 1]))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(C("bits").bitwiseAND(C("r.bit")) != 0, C("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(C("bits") == C("r.bit"), C("n")).otherwise(0)).alias("failed_alone"),
        )
    )


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = mask_of("few_words", "repeated_words")
    rows = apply_policy(ledger(read_table(spark, sf_dir, "documents")), POLICIES["v2"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (C("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "fail_bits")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
             (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::INTEGER AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
