"""Pile-ons as they happen: who takes part is told once a fifth amplifier is there.

Events of a post are kept by time bucket of the span's length; an event goes to
its own bucket and to the one before, so that every span lies whole in one
bucket's state, and a post that goes on for long is spread over its buckets. A late
event joins the others of its bucket as any other does. When the watermark has
passed both of a bucket's stretches no event can join it any more: a timer drops
its state.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import DAY, LEAST

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, as state of many variables must be."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def participants(times: np.ndarray, amplifiers: list, seconds: int, least: int) -> set:
    """Amplifiers with an event in a span of ``seconds`` (inclusive) that has ``least`` distinct ones; one sweep over the sorted events."""
    order = np.argsort(times, kind="stable")
    inside, lo, upto, found = Counter(), 0, 0, set()
    for n, i in enumerate(order.tolist()):
        inside[amplifiers[i]] += 1
        while times[order[lo]] < times[i] - seconds:
            gone = amplifiers[order[lo]]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            lo += 1
        if len(inside) >= least:
            found.update(amplifiers[order[k]] for k in range(max(lo, upto), n + 1))
            upto = n + 1
    return found


class PileOn(StatefulProcessor):
    """State of one (post, bucket): its events by amplifier and second, and who has been told."""

    def __init__(self, seconds: int, least: int):
        self.seconds, self.least = seconds, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "amplifier string, t long")
        self.told = handle.getListState("told", "amplifier string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = {(a, int(t)) for frame in rows for a, t in zip(frame.amplifier, frame.t, strict=True)}
        held = {(a, t) for a, t in self.events.get()}
        if not held:
            self.handle.registerTimer((int(key[1]) + 2) * self.seconds * 1000)
        # Each call to the state is a message to the JVM: all that is new goes in one.
        added = sorted(new - held)
        if added:
            self.events.appendList(added)
        held |= new
        amplifiers, times = [a for a, _ in held], np.array([t for _, t in held], np.int64)
        if len(set(amplifiers)) >= self.least:
            found = participants(times, amplifiers, self.seconds, self.least)
            fresh = sorted(found - {a for (a,) in self.told.get()}) if found else []
            if fresh:
                self.told.appendList([(a,) for a in fresh])
                yield pd.DataFrame({"post": key[0], "bucket": key[1], "amplifier": fresh})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        self.told.clear()
        yield from ()

    def close(self) -> None:
        pass


def online(events: DataFrame, late: str = "1 day", seconds: int = DAY, least: int = LEAST) -> DataFrame:
    """post, amplifier of a stream of events (post, amplifier, ts): each once for a bucket in which it takes part in a pile-on.

    Events later than ``late`` aren't looked at. Start the stream inside :func:`keyed_state`, in append or update mode.
    """
    kinds = dict(events.dtypes)
    t = F.unix_timestamp("ts")
    own = F.floor(t / seconds)
    rows = events.where("ts is not null and amplifier is not null and post is not null").withWatermark("ts", late)
    rows = rows.select("ts", "post", F.explode(F.array(own - 1, own)).alias("bucket"), F.col("amplifier").cast("string").alias("amplifier"), t.alias("t"))
    out = f"post {kinds['post']}, bucket long, amplifier string"
    found = rows.groupBy("post", "bucket").transformWithStateInPandas(PileOn(seconds, least), out, "append", "eventTime")
    return found.select("post", F.col("amplifier").cast(kinds["amplifier"]).alias("amplifier"))
