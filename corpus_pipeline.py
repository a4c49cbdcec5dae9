"""The corpus pipeline: quality, lines, near copies, test leaks, mixture.

Defined results: a document whose text is null or empty is kept by the quality
stage and has an empty text from the line stage on; all such documents are near
copies of one another, of which the smallest doc_id stays. Documents without
doc_id pass the quality stage and go at the line stage, as they cannot be named.
Rows that repeat a doc_id are one document: the stages keep all of them or none,
but for rows of one id with different texts, whose lines and leaks are judged by
row. Null labels, languages and sources are allowed. An item of the benchmark
with fewer words than a window is one window, so a one-word item takes every
document with that word. Empty tables give an empty result; without labels
nothing is rejected and all rates are 1. Further columns of the tables are
dropped by the first stage, so none can clash. ``copies`` of the mixture is a
column, how often a row is to be read, not repeated rows; rows of 0 copies go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney, line_dedup, mixing, positional_index, simhash
from tidemark.llm.scratch import discard, keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model rejects go."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first only; n_chars follows."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs).select(COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = positional_index.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to their target weights."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", leaks),
    ("mixing sources to target weights", mixture),
]

#: SQL can express neither the n-gram model nor the fitted rates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
