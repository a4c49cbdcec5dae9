"""Finding accounts: backlinks, author search, lists and harvested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import first_of


def backlinks(links: DataFrame, limit: int = 100) -> DataFrame:
    """The newest ``limit`` links of each (subject, source). links: subject, source, author, seq."""
    w = Window.partitionBy("subject", "source").orderBy(F.desc("seq"))
    return links.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def amplification(posts: DataFrame, links: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Links to the posts (uri) from the given sources, with the event type of each; one row a link of its own."""
    kind = F.create_map(*[F.lit(x) for kv in sources.items() for x in kv])[F.col("source")]
    hit = links.where(F.col("source").isin(list(sources))).join(posts.select(F.col("uri").alias("subject")).distinct(), "subject", "left_semi")
    return hit.withColumn("event_type", kind)


def authors(posts: DataFrame, phrase: str, most: int) -> DataFrame:
    """The first ``most`` distinct authors (account_id) of posts that hold the phrase in any case, with the first such post."""
    found = posts.where(F.contains(F.lower("text"), F.lit(phrase.lower())))
    return found.groupBy("account_id").agg(F.min("seq").alias("first_seq")).orderBy("first_seq", "account_id").limit(most)


def unscored(found: DataFrame, scored: DataFrame) -> DataFrame:
    """Distinct accounts that have no score yet."""
    return found.select("account_id").distinct().join(scored.select("account_id"), "account_id", "left_anti")


def lists(rows: DataFrame, purpose: str | None = None, members: int = 0, pattern: str | None = None) -> DataFrame:
    """Lists (name, purpose, members) of a purpose, a least size and a name pattern."""
    out = rows.where(F.col("members") >= members)
    out = out.where(F.col("purpose") == purpose) if purpose else out
    return out.where(F.col("name").rlike(pattern)) if pattern else out


def harvest(posts: DataFrame, least: int = 15, pattern: str | None = None, each: int | None = None) -> DataFrame:
    """Posts long enough that match, the first of each text, and at most ``each`` of an account, in order."""
    long_enough: Column = F.char_length("text") >= least
    out = posts.where(long_enough & F.col("text").rlike(pattern) if pattern else long_enough)
    out = first_of(out, ["text"], ["seq"])
    if each is None:
        return out
    w = Window.partitionBy("account_id").orderBy("seq")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")
