"""Finding accounts to score: through the follow graph, and through topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, graph, topics
from ..operators.verdicts import Classifier
from ..sources.store import Store
from . import phases

#: Authors (account_id) of posts that match a keyword, at most so many.
Search = Callable[[str, int], DataFrame]


def graph_sweep(edges: DataFrame, me, scores: DataFrame, as_of, days: int = 7, most: int | None = None) -> DataFrame:
    """Followers of my followers that have no fresh score; with ``most``, the first of them by id."""
    found = graph.stale(graph.second_degree(edges, me), scores, as_of, days)
    return found if most is None else found.orderBy("account_id").limit(most)


def search_keywords(clusters: DataFrame, me, n: int) -> list[str]:
    rows = topics.top_keywords(clusters.where(F.col("account_id") == F.lit(me)), n=n).orderBy("position").collect()
    return list(dict.fromkeys(r.keyword for r in rows))


def topic_sweep(keywords: list[str], search: Search, scored: DataFrame, each: int = 25) -> tuple[DataFrame, list[str]]:
    """(authors found without a score, keywords whose search failed). That every search fails is an error, not an empty find."""
    found, failed, last = None, [], None
    for k in keywords:
        try:
            part = search(k, each).select("account_id")
            found = part if found is None else found.unionByName(part)
        except Exception as e:  # noqa: BLE001
            failed.append(k)
            last = e
    if keywords and found is None:
        raise RuntimeError(f"all {len(keywords)} searches failed") from last
    if found is None:
        found = scored.select("account_id").where("false")
    return discovery.unscored(found, scored), failed


def both(keywords: list[str], search: Search, edges: DataFrame, me, scores: DataFrame, as_of, each: int = 25, days: int = 7) -> DataFrame:
    """account_id, source: topic first, then graph; the graph is left out where the topic sweep was degraded. An account found by both is a topic's."""
    topic, failed = topic_sweep(keywords, search, scores, each)
    topic = topic.select("account_id", F.lit("topic").alias("source"))
    if failed:
        return topic
    walked = graph_sweep(edges, me, scores, as_of, days).select("account_id", F.lit("graph").alias("source"))
    return topic.unionByName(walked.join(topic.select("account_id"), "account_id", "left_anti"))


def scored(store: Store, found: DataFrame, posts: DataFrame, texts: DataFrame, overlap: DataFrame, classify: Classifier, batch: int | None = None, owner: str | None = None) -> DataFrame | None:
    """The accounts that a sweep found, scored by the phased run over their posts (no pile-ons and no context in a sweep).

    Who was found is written once: a run that was stopped goes on with the same accounts. None if it was stopped again.
    """
    at = store.state()
    if "sweep_found" not in at.tables:
        store.replace_all({"sweep_found": found.select("account_id").distinct()}, since=at)
    these = store.read("sweep_found")
    of = posts.join(these, "account_id", "left_semi")
    return phases.run(store, of, texts, overlap, these.where("false"), classify, batch=batch, owner=owner)
