"""Account scores from posts, and the ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import posts as P


def account_scores(posts: DataFrame, overlap: DataFrame, pile_on: DataFrame, context: DataFrame | None = None, distance: DataFrame | None = None) -> DataFrame:
    """One row an account. overlap: account_id, overlap. pile_on: account_id. context: account_id, context. distance: account_id, graph_distance."""
    tox = P.toxicity(posts).select("account_id", "toxicity")
    seen = P.ratios(posts).join(P.engagement(posts), "account_id")
    # One row: the median over all accounts.
    median = P.median_of(seen, "avg_engagement")
    s = seen.join(tox, "account_id").join(overlap, "account_id", "left").crossJoin(F.broadcast(median))
    s = s.join(pile_on.select("account_id", F.lit(True).alias("pile_on")).distinct(), "account_id", "left").withColumn("pile_on", F.coalesce("pile_on", F.lit(False)))
    s = s.join(context, "account_id", "left") if context is not None else s.withColumn("context", F.lit(None).cast("double"))
    s = s.join(distance, "account_id", "left") if distance is not None else s.withColumn("graph_distance", F.lit(None).cast("string"))
    s = s.withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    q, r, p = F.col("quote_ratio"), F.col("reply_ratio"), F.col("pile_on")
    s = s.withColumn("base", scoring.threat(F.col("toxicity"), F.col("overlap"))).withColumn("boost", scoring.boost(q, r, p))
    s = s.withColumn("benign", scoring.benign(q, r, p, F.col("avg_engagement"), F.col("median")))
    raw, left = scoring.behavioural_in_context(F.col("base"), F.col("benign"), F.col("boost"), F.col("context"))
    s = s.withColumn("behavioural", raw).withColumn("context_left", left)
    s = s.withColumn("score", scoring.final(F.col("behavioural"), F.col("context_left"), F.col("graph_distance")))
    s = s.withColumn("tier", scoring.tier(F.col("score")))
    return s.withColumn("quality", scoring.fingerprint_quality(F.col("n_original"), F.col("n_reply") + F.col("n_quote")))


def page(scores: DataFrame, number: int = 1, size: int = 50, tier: str | None = None, search: str | None = None, key: str = "account_id") -> DataFrame:
    """A page of the ranked list; an unknown tier filters nothing. Ranks go on over pages."""
    number, size = max(number, 1), min(max(size, 1), 200)
    out = scores.where("score is not null")
    if tier and tier.lower() in {"low", "watch", "elevated", "high"}:
        out = out.where(F.lower("tier") == tier.lower())
    if search:
        out = out.where(F.contains(F.lower(F.col(key).cast("string")), F.lit(search.lower())))
    skip = (number - 1) * size
    top = out.orderBy(F.desc("score"), key).offset(skip).limit(size)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col(key).alias("k"), F.struct(*top.columns).alias("r")))).alias("rows"))
    ranked = listed.select(F.posexplode("rows").alias("i", "x"))
    return ranked.select((F.col("i") + 1 + skip).cast("long").alias("rank"), "x.r.*")
