"""A durable work queue of keyed deltas in a store.

What is queued and what is judged are appended rows; nothing that is there is
rewritten. The newest queued row of a key holds, but its verdict is the first that
was given since: a finished row that is queued again keeps its verdict. A row of a
failed try (``failure``) decides nothing; the row stays pending.

Deltas are ordered by the number of the log entry that they were worked out from, so
one that is appended later counts as later. A key is put together in one grouping,
whatever the number of deltas; the store merges their folders as they come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import VERDICT, Store, latest

KEYS = ["account_id", "uri"]
SEQ, KIND = "_seq", "_kind"
#: What a verdict sets, besides the status, and what a failed try leaves.
GIVEN = {"toxic_token": "boolean", "confidence": "double", "model_id": "string", "policy_version": "string", "failure": "string"}


def _delta(store: Store, rows: DataFrame, kind: str) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in GIVEN.items() if c not in rows.columns}
    return rows.withColumns(missing | {KIND: F.lit(kind), SEQ: F.lit(store.state().number).cast("long")})


def push(store: Store, name: str, rows: DataFrame, keys: list[str] = KEYS) -> None:
    """Queue rows (with ``status``), new ones or anew. Of repeated rows one counts. Doing it twice changes nothing."""
    store.append(name, _delta(store, latest(rows, keys), "row"))


def judge(store: Store, name: str, tried: DataFrame, keys: list[str] = KEYS) -> None:
    """Outcomes of rows: a verdict where ``toxic_token`` is set, else a failed try."""
    cols = [*keys, *(c for c in GIVEN if c in tried.columns)]
    status = F.when(F.col("toxic_token").isNotNull(), "done").otherwise("pending")
    store.append(name, _delta(store, tried.select(*cols).withColumn("status", status), "verdict"))


def folded(deltas: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The queue as it stands: one row a key."""
    own = [c for c in deltas.columns if c not in (*keys, SEQ, KIND, "failure")]
    held = [c for c in VERDICT if c in own]
    queued, done = F.col(KIND) == "row", F.col("status") == "done"
    at = lambda when: F.when(when, F.col(SEQ))
    rows = deltas.groupBy(*keys).agg(
        F.max_by(F.struct(*own), at(queued)).alias("_row"),
        F.min_by(F.struct(*held), at(done)).alias("_done"),
        F.max_by("failure", at(F.col("failure").isNotNull())).alias("failure"),
    )
    out = [F.when(F.col("_done").isNotNull(), F.col(f"_done.{c}")).otherwise(F.col(f"_row.{c}")).alias(c) if c in held else F.col(f"_row.{c}").alias(c) for c in own]
    failed: Column = F.when(F.col("_done").isNull() & (F.col("_row.status") != "done"), F.col("failure")).alias("failure")
    return rows.where("_row is not null").select(*keys, *out, failed)


def current(store: Store, name: str, keys: list[str] = KEYS) -> DataFrame:
    return folded(store.read(name), keys)


def clear(store: Store, name: str, of: DataFrame) -> None:
    """All deltas of the keys in ``of`` go (rewrites the queue: for one pass of recovery, not for each batch)."""
    since = store.state()
    store.replace_all({name: store.read(name, since).join(of, of.columns, "left_anti")}, since=since)
