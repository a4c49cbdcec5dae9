"""The phased scan: gather, burst, finalize, each a written table, so a killed run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import envelope
from ..operators import posts as P
from ..operators import metrics, verdicts
from ..sources import queue as Q
from ..sources import store as S
from ..sources.queue import KEYS
from . import ranking

PHASES = ["gather", "burst", "finalize", "done"]
SCHEMA_VERSION = 2


def gather(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """Queue rows of assessable accounts: clean posts are done, the rest pending; posts without a score are left out."""
    ok = P.assess(posts).where("outcome = 'Score'").select("account_id")
    rows = P.with_parents(P.newest(posts.join(ok, "account_id", "left_semi"), 50), texts).where("score is not null")
    clean = F.col("score") < scoring.CLEAN
    return rows.select(
        "account_id",
        "uri",
        envelope(F.col("parent_text"), F.col("text")).alias("text"),
        "post_kind",
        "score",
        F.when(clean, "done").otherwise("pending").alias("status"),
        F.when(clean, False).alias("toxic_token"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def burst(queue: DataFrame, classify: verdicts.Classifier) -> DataFrame:
    """Pending rows judged; only those reach the classifier."""
    judged = classify(queue.where("status = 'pending'")).select("account_id", "uri", "toxic_token", "confidence")
    return S.record_verdicts(queue, judged, KEYS)


@dataclass(frozen=True)
class Drained:
    """How a drain ended: complete, cost_capped or interrupted; the last two can be resumed."""

    status: str
    judged: int = 0
    errored: int = 0


class BurstAborted(RuntimeError):
    """A failure that would come again each time."""


def drain(store: S.Store, classify: verdicts.Classifier, batch: int | None = None, spend: Callable[[int], bool] = lambda n: True) -> Drained:
    """Pending rows judged batch by batch, each committed, until none is left; a killed drain goes on with what is pending.

    The pending rows are numbered and dealt into batches once; a batch appends what it was
    given, so all that is written grows with the rows, not with batches times rows.
    ``spend`` is asked before each batch of n rows; if it says no the drain ends as
    cost_capped. The classifier may add ``failure`` (see ``classify.in_chunks``; rows
    have their number ``_n``): what went well is kept, then the cost cap counts first, then an abort,
    which is raised, then what may be tried in a later drain. A row without verdict
    is asked once in a drain.
    """
    waiting = Q.current(store, "queue").where("status = 'pending'").select(*KEYS, "text", "score")
    staged = S.stage(waiting, KEYS, f"{store.root}/_staged")
    numbers = S.numbered(store.spark, staged, "_n", -1)
    batches = store.replace("burst_batches", numbers.withColumn("batch", F.floor(F.col("_n") / batch) if batch else F.lit(0)), "batch")
    store.unstage(staged)
    sizes = {r.batch: r["count"] for r in batches.groupBy("batch").count().collect()}
    judged = errored = 0
    for b in sorted(sizes):
        if not spend(sizes[b]):
            return Drained("cost_capped", judged, errored)
        tried = classify(batches.where(F.col("batch") == b).drop("batch"))
        tried = tried.withColumns({c: F.lit(None).cast("string") for c in ("failure", "detail", "model_id") if c not in tried.columns})
        # The pass that appends the verdicts is the one that counts them: the classifier is asked once.
        tried, seen = metrics.watched(tried, metrics.classification(tried))
        Q.judge(store, "queue", tried)
        judged, errored = judged + seen.get["judged"], errored + seen.get["decode_errors"]
        if seen.get["cost_cap"]:
            return Drained("cost_capped", judged, errored)
        if seen.get["abort"]:
            raise BurstAborted(seen.get["abort_detail"])
        if seen.get["transient"]:
            return Drained("interrupted", judged, errored)
    return Drained("complete", judged, errored)


def finalize(queue: DataFrame, overlap: DataFrame, pile_on: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores of complete accounts, skipped accounts)."""
    state = verdicts.complete(queue)
    whole = state.where("complete").select("account_id")
    judged = queue.join(whole, "account_id", "left_semi").select("account_id", "uri", F.coalesce("toxic_token", F.lit(False)).alias("is_toxic"))
    rows = posts.drop("is_toxic").join(judged, ["account_id", "uri"])
    skipped = state.where("not complete").select("account_id", F.lit("finalize").alias("phase"), F.lit("verdicts missing").alias("error"))
    return ranking.account_scores(rows, overlap, pile_on), skipped


def recover(store: S.Store, accounts: DataFrame, posts: DataFrame, texts: DataFrame, classify: verdicts.Classifier, batch: int | None = None) -> Drained:
    """One pass for accounts that lack verdicts: their rows are cleared, gathered anew and judged. Whoever still lacks some stays skipped."""
    Q.clear(store, "queue", accounts.select("account_id"))
    Q.push(store, "queue", gather(posts.join(accounts, "account_id", "left_semi"), texts))
    return drain(store, classify, batch)


def not_assessed(posts: DataFrame) -> DataFrame:
    """Terminal rows of accounts whose posts are mostly in languages that can't be assessed: no score, a tier of their own."""
    gate = P.assess(posts).where("outcome = 'NotAssessed'")
    return gate.select("account_id", F.lit("NotAssessed").alias("tier"), F.lit(None).cast("double").alias("score"), (F.col("assessable") + F.col("unassessable")).alias("posts_analyzed"))


def run(
    store: S.Store, posts: DataFrame, texts: DataFrame, overlap: DataFrame, pile_on: DataFrame, classify: verdicts.Classifier, stop_after: str | None = None, batch: int | None = None,
    spend: Callable[[int], bool] = lambda n: True, owner: str | None = None, lease: float = 3600,
) -> DataFrame | None:
    """Go on from the stored marker. An unknown marker fails. ``stop_after`` ends early, for tests.

    Accounts that lack verdicts after the burst are gathered and judged once
    more. If the burst is stopped by the cost cap or a passing failure the run ends
    there, with None, and another one goes on with what is pending. With ``owner``
    the run holds the lease ``scan``, renewed at each phase: a second run is refused
    (``Held``) until this one ends or has outlived its lease.
    """
    if owner:
        store = store.take_lease("scan", owner, lease)
        try:
            return _run(store, posts, texts, overlap, pile_on, classify, stop_after, batch, spend, lease)
        finally:
            store.give_up_lease()
    return _run(store, posts, texts, overlap, pile_on, classify, stop_after, batch, spend, None)


def _run(store: S.Store, posts: DataFrame, texts: DataFrame, overlap: DataFrame, pile_on: DataFrame, classify: verdicts.Classifier, stop_after: str | None, batch: int | None, spend: Callable[[int], bool], lease: float | None) -> DataFrame | None:
    spark = posts.sparkSession
    marker = store.read("scan_state").first()["value"] if store.current("scan_state") else PHASES[0]
    if marker not in PHASES:
        raise ValueError(f"unknown phase {marker!r}")
    steps: dict[str, Callable[[], Drained | None]] = {
        "gather": lambda: Q.push(store, "queue", gather(posts, texts)),
        "burst": lambda: drain(store, classify, batch, spend),
        "finalize": lambda: _finalized(store, overlap, pile_on, posts, texts, classify, batch),
    }
    for phase, following in zip(PHASES, PHASES[1:], strict=False):
        if PHASES.index(marker) <= PHASES.index(phase):
            if lease:
                store.renew_lease(lease)
            ended = steps[phase]()
            if ended and ended.status != "complete":
                return None
            store.replace("scan_state", spark.createDataFrame([(following,)], "value string"))
            if phase == stop_after:
                return None
    return store.read("account_scores")


def _finalized(store: S.Store, overlap: DataFrame, pile_on: DataFrame, posts: DataFrame, texts: DataFrame, classify: verdicts.Classifier, batch: int | None) -> None:
    lacking = verdicts.complete(Q.current(store, "queue")).where("not complete").select("account_id")
    lacking = store.replace("lacking", lacking)
    if not lacking.isEmpty():
        recover(store, lacking, posts, texts, classify, batch)
    scored, skipped = finalize(Q.current(store, "queue"), overlap, pile_on, posts)
    store.replace_all({"account_scores": scored, "scan_skips": skipped})
