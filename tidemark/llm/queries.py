"""The operators applied to whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, license_scan, line_dedup, log_bilinear, merkle, mixing, mtree, periodic_runs, permutation_index, positional_index, rlz_dedup, simhash, toxicity
from .scratch import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=positional_index.SPAN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.scores(table(spark, sf_dir, "documents"))


def op11_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_permutation_index,
        op2_decontamination,
        op3_substring_dedup,
        op4_mixing,
        op5_simhash,
        op6_line_dedup,
        op7_license_scan,
        op8_toxicity,
        op9_quality,
        op10_log_bilinear,
        op11_mtree,
        op12_periodic_runs,
        op13_merkle,
    )
}
