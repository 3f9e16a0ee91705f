"""A corpus pipeline over ``documents``: identified languages, one document of each
near-duplicate group, no personal data, sources mixed to weights, and tokens.

Each stage's result is written as Parquet and read again as the next one's input.  Stages keep
columns of any other name as they are; an empty table passes through; very long texts are read
whole, in parts where an operator needs arrays of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common, language, mixing, nearcopies, pii, sentencepiece

#: How far from an even guess among the languages towards certainty a document's mean position
#: probability must lie, for its language to count as identified.  On held-out documents of sf0.1,
#: 0.3 rejects none, and 93 % of texts of random letters (README).
LEAST_SURENESS = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language isn't
    identified.  Equal texts stay or go together."""
    return language.keep_identified(docs, language.learn(docs), LEAST_SURENESS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id (null after others) of each group of near copies:
    five-word shingles alike to 0.8 or more.  Of rows that repeat one stays; texts that are null or
    have no word are one group."""
    return nearcopies.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts by its kind; a null text stays null, all rows stay."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come to their targets.  A null source is a source;
    documents without a word are dropped; repeated rows are documents of their own."""
    return mixing.mixed(docs, [5, 2, 1], 1.5, 2.0)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids of each document, a row for each copy; a null or empty text has no ids."""
    out = sentencepiece.encode(docs, sentencepiece.Pieces.load())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mix", mix), ("tokens", tokenize)]

#: No stage but mixing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
