"""The follow graph as an edge table: src follows dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MUTUAL, INBOUND, OUTBOUND, STRANGER = "Mutual follow", "Follows you", "You follow", "Stranger"


def distance(accounts: DataFrame, edges: DataFrame, me: int | str) -> DataFrame:
    """accounts (account_id) with graph_distance to ``me``."""
    out = edges.where(F.col("src") == me).select(F.col("dst").alias("account_id"), F.lit(True).alias("following")).distinct()
    into = edges.where(F.col("dst") == me).select(F.col("src").alias("account_id"), F.lit(True).alias("followed_by")).distinct()
    kind = (
        F.when(F.col("following") & F.col("followed_by"), MUTUAL)
        .when(F.col("followed_by"), INBOUND)
        .when(F.col("following"), OUTBOUND)
        .otherwise(STRANGER)
    )
    joined = accounts.join(out, "account_id", "left").join(into, "account_id", "left")
    return joined.withColumn("graph_distance", kind).drop("following", "followed_by")


def second_degree(edges: DataFrame, me: int | str) -> DataFrame:
    """Followers of my followers that are neither me nor my followers."""
    first = edges.where(F.col("dst") == me).select(F.col("src").alias("account_id")).distinct()
    second = edges.join(first, edges["dst"] == first["account_id"], "left_semi").select(F.col("src").alias("account_id")).distinct()
    return second.join(first, "account_id", "left_anti").where(F.col("account_id") != me)


def drive_by(repliers: DataFrame, edges: DataFrame, me: int | str) -> DataFrame:
    """Repliers (account_id) that I don't follow, without me."""
    mine = edges.where(F.col("src") == me).select(F.col("dst").alias("account_id"))
    return repliers.join(mine, "account_id", "left_anti").where(F.col("account_id") != me)


def stale(candidates: DataFrame, scores: DataFrame, as_of, days: int) -> DataFrame:
    """Candidates without a score of the last ``days`` days; the rest are the fresh."""
    cut = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    fresh = scores.where(F.col("scored_at") >= cut).select("account_id")
    return candidates.join(fresh, "account_id", "left_anti")
