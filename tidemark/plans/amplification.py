"""From amplification events to the accounts to score, with all that scoring needs of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import graph
from ..sources.store import State, Store
from . import context, ranking, steps

SAID = ["quote", "reply"]


def record(store: Store, events: DataFrame) -> DataFrame:
    """New events appended with ids in order of detection; those that the store has by key are left out."""
    key = E.event_key(F.col("event_type"), F.col("amplifier").cast("string"), F.col("post").cast("string"), F.col("uri").cast("string"))
    fresh = E.first_of(events.withColumn("key", key), ["key"], ["ts", "uri"])
    since = store.state()
    if "events" in since.tables:
        fresh = fresh.join(store.read("events", since).select("key"), "key", "left_anti")
    return store.append("events", fresh, "ts", "event_id", upon=since)


def candidates(events: DataFrame, originals: DataFrame, edges: DataFrame, me, scores: DataFrame, as_of, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(accounts, direct pairs): amplifiers first, then followers, without me and without those that have a fresh score.

    Accounts have origin, pile_on, graph_distance and whether they have direct
    pairs. events: amplifier, post, event_type, ts, text. originals: post, text.
    edges: src, dst. scores: account_id, scored_at.
    """
    amplifiers = events.select(F.col("amplifier").alias("account_id")).distinct().withColumn("origin", F.lit("amplifier"))
    followers = edges.where(F.col("dst") == F.lit(me)).select(F.col("src").alias("account_id")).distinct().withColumn("origin", F.lit("follower"))
    found = E.by_precedence(amplifiers, followers, "account_id").where(F.col("account_id") != F.lit(me))
    found = graph.distance(graph.stale(found, scores, as_of, days), edges, me)
    piled = E.pile_on(events).select(F.col("amplifier").alias("account_id"), F.lit(True).alias("pile_on"))
    told, texts = context.answered(events.where(F.col("event_type").isin(SAID)), originals)
    pairs = context.pairs_of(told, texts)
    found = found.join(piled, "account_id", "left").join(context.pairs_counted(told), "account_id", "left")
    return found.withColumns({"pile_on": F.coalesce("pile_on", F.lit(False)), "direct_pairs": F.coalesce("direct_pairs", F.lit(0))}), pairs


def scored(
    store: Store, run_id: str, events: DataFrame, originals: DataFrame, edges: DataFrame, me, posts: DataFrame, overlap: DataFrame, targets: DataFrame, mine: DataFrame,
    score_pairs: context.PairScorer, known: DataFrame, as_of, days: int = 7, stop_after: str | None = None,
) -> DataFrame | None:
    """From events to scores in restartable steps; the scores of this run's candidates, best first by ``score`` and id.

    record: new events, with those that the store has. candidates: who is to be scored, with pile-on, distance and direct
    pairs. first: scores without context. context: hostility of direct pairs, and of inferred pairs for accounts that have
    none and come up to Watch. score: scores with everything. ``known`` has the accounts that were scored before, with scored_at;
    for the other arguments see ``candidates``, ``context.inferred_pairs`` and ``ranking.account_scores``.
    """

    def recorded(_: State) -> dict[str, DataFrame]:
        record(store, events)
        return {}

    def chosen(at: State) -> dict[str, DataFrame]:
        found, pairs = candidates(store.read("events", at), originals, edges, me, known, as_of, days)
        # Worked out once: the pairs are cut to what was written, whose size Spark knows.
        kept = store.read("candidates", State(0, {"candidates": [store.write("candidates", found)]}))
        return {"candidates": kept, "direct_pairs": pairs.join(kept.select("account_id"), "account_id", "left_semi")}

    def scores(at: State, told: DataFrame | None) -> DataFrame:
        these = store.read("candidates", at)
        of = posts.join(these.select("account_id"), "account_id", "left_semi")
        return ranking.account_scores(of, overlap, these.where("pile_on").select("account_id"), told, these.select("account_id", "graph_distance"))

    def hostile(at: State) -> dict[str, DataFrame]:
        these = store.read("candidates", at).select("account_id")
        made = context.contexts(store.read("first_scores", at), store.read("direct_pairs", at), targets.join(these, "account_id", "left_semi"), mine, score_pairs)
        return {"contexts": made}

    done = steps.go_on(
        store,
        "amplification",
        run_id,
        [
            ("record", recorded),
            ("candidates", chosen),
            ("first", lambda at: {"first_scores": scores(at, None)}),
            ("context", hostile),
            ("score", lambda at: {"account_scores": scores(at, store.read("contexts", at))}),
        ],
        stop_after,
    )
    return store.read("account_scores").orderBy(F.desc("score"), "account_id") if done else None
