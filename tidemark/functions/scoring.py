"""Scores, tiers and weights. A NaN stays NaN through every clamp and is Low as a tier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    toxicity: float = 70.0
    overlap: float = 1.5
    gate: float = 0.15
    gate_cap: float = 25.0


#: Fixed values.
TIERS = {"High": 35.0, "Elevated": 15.0, "Watch": 8.0}
DISTANCE = {"Mutual follow": 0.6, "Follows you": 0.8, "You follow": 0.9, "Stranger": 1.2}
BENIGN_CAP, BYPASS, CONTEXT = 12.0, 0.5, 0.5
CLEAN = 0.10
STALE_DAYS = {"low": 3, "standard": 7, "high": 14}


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def threat(toxicity: Column, overlap: Column, w: Weights = Weights()) -> Column:  # noqa: B008
    gated = F.least(toxicity * w.gate_cap, F.lit(w.gate_cap))
    return clamp(F.when(overlap < w.gate, gated).otherwise(toxicity * w.toxicity * (1 + overlap * w.overlap)))


def threat_in_context(toxicity: Column, overlap: Column, context: Column) -> Column:
    return clamp(threat(toxicity, overlap) * (1 + F.coalesce(context, F.lit(0.0)) * CONTEXT))


def tier(score: Column) -> Column:
    out = F.when(F.isnan(score), "Low")
    for name, least in TIERS.items():
        out = out.when(score >= least, name)
    return out.otherwise("Low")


def tier_at_read(stored: Column, score: Column) -> Column:
    """Recomputed from the score, but a row that could not be assessed stays so."""
    return F.when(stored == "NotAssessed", stored).when(score.isNull(), stored).otherwise(tier(score))


def boost(quote: Column, reply: Column, pile_on: Column) -> Column:
    return 1 + 0.20 * quote + 0.15 * reply + F.when(pile_on, 0.15).otherwise(0.0)


def benign(quote: Column, reply: Column, pile_on: Column, engagement: Column, median: Column) -> Column:
    return (quote < 0.15) & (reply < 0.30) & ~pile_on & (engagement > median)


def behavioural(score: Column, is_benign: Column, boosted: Column) -> Column:
    return F.when(is_benign, F.least(score, F.lit(BENIGN_CAP))).otherwise(clamp(score * boosted))


def behavioural_in_context(score: Column, is_benign: Column, boosted: Column, context: Column) -> tuple[Column, Column]:
    """(score, the context that is left): strong hostility lifts the cap and is used up by it."""
    strong = is_benign & (F.coalesce(context, F.lit(0.0)) >= BYPASS)
    out = F.when(strong, clamp(score * boosted)).otherwise(behavioural(score, is_benign, boosted))
    return out, F.when(strong, F.lit(None).cast("double")).otherwise(context)


def distance_weight(distance: Column) -> Column:
    out = F.lit(1.0)
    for name, w in DISTANCE.items():
        out = F.when(distance == name, w).otherwise(out)
    return out


def final(score: Column, context: Column, distance: Column) -> Column:
    return clamp(score * F.coalesce(1 + context * CONTEXT, F.lit(1.0)) * distance_weight(distance))


def hostility(attack: Column, contempt: Column, misrepresent: Column, good_faith: Column, support: Column) -> Column:
    return clamp(F.greatest(attack, contempt, misrepresent) - F.greatest(0.5 * good_faith, 0.8 * support), 0.0, 1.0)


def softmax_entailment(logits: Column) -> Column:
    """Share of the second of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.element_at(e, 2) / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def scores_of_logits(logits: Column) -> Column:
    """Seven logits to six named scores; obscenity counts as profanity and the seventh is dropped."""
    names = ["toxicity", "severe_toxicity", "profanity", "identity_attack", "insult", "threat"]
    return F.struct(*[sigmoid(F.element_at(logits, i + 1)).alias(n) for i, n in enumerate(names)])


def weighted_toxicity(toxic_replies: Column, replies: Column, toxic_others: Column, others: Column) -> Column:
    """Replies weigh 0.7 once there are five; before that the plain rate."""
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    flat = rate(toxic_replies + toxic_others, replies + others)
    return F.when(replies < 5, flat).otherwise(0.7 * rate(toxic_replies, replies) + 0.3 * rate(toxic_others, others))


def fingerprint_quality(originals: Column, others: Column) -> Column:
    return (
        F.when(originals >= 15, "normal")
        .when(originals == 0, "unreliable")
        .when(originals + others >= 15, "degraded")
        .otherwise("unreliable")
    )


def confidence(quality: Column, early_exit: Column) -> Column:
    return F.when(early_exit, "low").when(quality == "normal", "high").otherwise("standard")


def stale_days(level: Column) -> Column:
    return F.when(level == "low", 3).when(level == "high", 14).otherwise(7)


def near_boundary(score: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in sorted(TIERS.values())]), lambda x: F.abs(x - score) <= 5)


def is_toxic(token: Column, level: Column, threshold: float) -> Column:
    return token & (level >= threshold)


def valid_slot(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)


def level_of_logprob(logprob: Column) -> Column:
    return F.exp(logprob)


def over_ceiling(seconds: Column, cents_an_hour: float, ceiling: float) -> Column:
    return seconds / 3600 * cents_an_hour >= ceiling


def cost_cents(milliseconds: Column, cents_an_hour: float) -> Column:
    return F.round(milliseconds / 3_600_000 * cents_an_hour, 4)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), F.round(100 * done / total)))


def done_of(total: Column, pending: Column) -> Column:
    return F.greatest(total - pending, F.lit(0))


def bar(weight: Column) -> Column:
    return F.repeat(F.lit("="), F.round(weight * 20).cast("int"))


def tier_rank(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "high", 3).when(low == "elevated", 2).when(low == "watch", 1).otherwise(0)
