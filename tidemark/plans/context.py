"""How hostile an account is to the protected user: pairs of texts, scored and averaged.

Direct pairs are what an amplifier answered and what it said. Inferred pairs are
for accounts that never answered: their posts nearest to what the user writes
about, each with the user's nearest post.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import language, scoring
from ..operators import nearest

#: Adds ``hostility`` (0 to 1, null where a pair can't be scored) to rows of original and response.
PairScorer = Callable[[DataFrame], DataFrame]
#: Answered posts, and bytes of their texts, that are sent to every task at most.
FEW_POSTS, FEW_BYTES = 1 << 14, 1 << 25
WATCH = scoring.TIERS["Watch"]


def answered(events: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account_id, digest, response; digest, original): who answered which text, and the texts that were answered, both sides non-empty.

    A text is known by its SHA-256, so that what is shuffled has one text a row. Where few posts were answered their texts
    go to every task, and no response is moved to meet them; else both are joined by a shuffle.
    """
    said = events.where("coalesce(text, '') <> ''").select(F.col("amplifier").alias("account_id"), "post", F.col("text").alias("response"))
    posts = events.select("post").distinct()
    few = posts.limit(FEW_POSTS + 1).count() <= FEW_POSTS
    of = originals.where("coalesce(text, '') <> ''").select("post", F.col("text").alias("original"))
    of = of.join(F.broadcast(posts) if few else posts, "post", "left_semi")
    few = few and (of.agg(F.sum(F.octet_length("original"))).first()[0] or 0) <= FEW_BYTES
    of = of.withColumn("digest", F.unhex(F.sha2("original", 256)))
    digests, texts = of.select("post", "digest").distinct(), of.groupBy("digest").agg(F.max("original").alias("original"))
    told = said.join(F.broadcast(digests) if few else digests, "post").select("account_id", "digest", "response")
    return told, F.broadcast(texts) if few else texts


def pairs_of(told: DataFrame, texts: DataFrame) -> DataFrame:
    """account_id, original, response: distinct. See ``answered``."""
    return told.distinct().join(texts, "digest").select("account_id", "original", "response")


def pairs_counted(told: DataFrame) -> DataFrame:
    """account_id, direct_pairs: the number of distinct pairs; only digests are shuffled."""
    by = told.select("account_id", "digest", F.unhex(F.sha2("response", 256)).alias("_r")).distinct()
    return by.groupBy("account_id").agg(F.count("*").alias("direct_pairs"))


def direct_pairs(events: DataFrame, originals: DataFrame) -> DataFrame:
    """account_id, original, response: distinct, both sides non-empty. events: amplifier, post, text. originals: post, text."""
    return pairs_of(*answered(events, originals))


def inferred_pairs(targets: DataFrame, mine: DataFrame, n: int = 3) -> DataFrame:
    """account_id, original, response, similarity: the n posts of each account nearest to the mean of mine, each with my nearest post.

    targets: account_id, target_id, text, a. mine: mine_id, text, b; a bounded sample.
    """
    top = nearest.top_by_mean(targets, mine, n)
    best = nearest.best_match(top.select("target_id", "a"), mine.select("mine_id", "b")).select("target_id", "mine_id")
    said = mine.select("mine_id", F.col("text").alias("original")).where("coalesce(original, '') <> ''")
    return top.select("account_id", "target_id", "similarity", F.col("text").alias("response")).join(best, "target_id").join(said, "mine_id").select("account_id", "original", "response", "similarity")


def context(pairs: DataFrame, score: PairScorer) -> DataFrame:
    """account_id, context: mean hostility of the pairs that can be assessed and scored; an account without such a pair has no row."""
    ok = language.pair_assessable(F.col("original"), F.col("response"))
    return score(pairs.where(ok)).where("hostility is not null").groupBy("account_id").agg(F.avg("hostility").alias("context"))


def needs_inferred(first_pass: DataFrame, direct: DataFrame) -> DataFrame:
    """Accounts whose first score is Watch or more and that have no direct pairs: only these are worth the second pass."""
    return first_pass.where(F.coalesce("score", F.lit(0.0)) >= WATCH).select("account_id").join(direct.select("account_id").distinct(), "account_id", "left_anti")


def contexts(first_pass: DataFrame, direct: DataFrame, targets: DataFrame, mine: DataFrame, score: PairScorer) -> DataFrame:
    """Direct pairs of every amplifier, inferred pairs of the others that pass the gate."""
    gated = targets.join(needs_inferred(first_pass, direct), "account_id", "left_semi")
    return context(direct, score).unionByName(context(inferred_pairs(gated, mine).drop("similarity"), score))
