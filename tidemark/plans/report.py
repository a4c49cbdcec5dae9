"""A Markdown report of the ranked list. What is collected is bounded by the number of rows shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import bar
from ..functions.text import markdown_cell, truncate_chars
from ..operators.verdicts import histogram


def markdown(scores: DataFrame, evidence: DataFrame, shown: int = 50, clusters: DataFrame | None = None, events: DataFrame | None = None, not_assessed: int = 0) -> str:
    """scores: account_id, score, tier. evidence: account_id, text, rank; shown for scores of 15 and more.

    clusters: label, keywords, weight of the user's topics. events: amplifier,
    event_type, ts, text; quotes that have a text are shown, newest first.
    """
    h = histogram(scores).first()
    lines = ["# Accounts by risk", "", *(f"- {k.replace('_', ' ')}: {h[k]}" for k in h.asDict()), "", "| Rank | Account | Score | Tier |", "| --- | --- | --- | --- |"]
    top = scores.where("score is not null").orderBy(F.desc("score"), "account_id").limit(shown)
    cell = markdown_cell(F.col("account_id").cast("string"))
    for i, r in enumerate(top.select(cell.alias("a"), "score", "tier").collect(), 1):
        lines.append(f"| {i} | {r.a} | {r.score:.1f} | {r.tier} |")
    held = top.where("score >= 15").select("account_id", "score").join(evidence.select("account_id", "text", "rank"), "account_id").orderBy(F.desc("score"), "account_id", "rank")
    lines += ["", "## Evidence", ""]
    for r in held.select("account_id", markdown_cell(truncate_chars(F.col("text"), 200)).alias("t")).collect():
        lines.append(f"- {r.account_id}: {r.t}")
    if clusters is not None:
        lines += ["", "## Topics", ""]
        named = clusters.orderBy(F.desc("weight"), "label").limit(shown).select("label", F.array_join(F.slice("keywords", 1, 8), ", ").alias("k"), bar(F.col("weight")).alias("bar"), "weight")
        lines += [f"- {r.label} {r.bar} {r.weight:.0%}: {r.k}" for r in named.collect()]
    if events is not None:
        quotes = events.where("event_type = 'quote' and coalesce(text, '') <> ''").orderBy(F.desc("ts"), "amplifier").limit(shown)
        lines += ["", "## Quotes", ""]
        lines += [f"- {r.day} {r.amplifier}: {r.t}" for r in quotes.select("amplifier", F.date_format("ts", "yyyy-MM-dd").alias("day"), markdown_cell(truncate_chars(F.col("text"), 200)).alias("t")).collect()]
    if not_assessed:
        lines += ["", f"{not_assessed} accounts could not be assessed, as most of their posts are in languages that the model does not read."]
    return "\n".join(lines) + "\n"
