"""From raw documents to packed training sequences: five stages, each an operator of tidemark.llm at work on what the last one kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. doc_id is the documents' key.
Rows without text have no words, so the rules reject them; rows that repeat a kept doc_id stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, pii, quality_classifier, quality_rules
from tidemark.llm.common import DOCUMENT_COLUMNS, cut, read_table

#: Ids up to which removed documents are broadcast (longs, so some tens of MB); beyond, documents are dealt out by id.
BROADCAST_IDS = 1_000_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject."""
    docs = docs.select(DOCUMENT_COLUMNS)
    weights = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.with_scores(docs, weights).filter(F.col("score") >= quality_classifier.THRESHOLD).select(DOCUMENT_COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the rule ledger."""
    rows = quality_rules.apply_policy(quality_rules.ledger(docs, carry=DOCUMENT_COLUMNS), quality_rules.POLICIES["v2"])
    return rows.filter("kept").select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8; the smallest doc_id stays."""
    docs = docs.select(DOCUMENT_COLUMNS)
    gone = cut(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(DOCUMENT_COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it taken out of their texts; n_chars follows the text."""
    rows = pii.sanitise(docs, carry=DOCUMENT_COLUMNS)
    return rows.select("doc_id", F.col("clean").alias("text"), "carried.lang", "carried.source", F.length("clean").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("minhash_near_dedup", deduplicate),
    ("pii", redact),
    ("best_fit_packing", pack),
]
#: SQL can't express a trained model, MinHash or a tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`; what a stage kept is written once before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
