"""Streams: a limiter for each key, event deduplication and a queue that drains itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import event_key
from ..sources import queue
from ..sources.store import Store


def allow(times: list[float], start: float | None, used: int, most: int, seconds: float) -> tuple[list[bool], float, int]:
    """A window starts at the first hit after the last one ended; ``most`` hits pass in it."""
    out = []
    for t in times:
        if start is None or t >= start + seconds:
            start, used = t, 0
        used += 1
        out.append(used <= most)
    return out, start if start is not None else 0.0, used


class Limiter(StatefulProcessor):
    """State of one shard of keys: when each key's window began and what it has had, for ``room`` keys at most.

    The map is read at the first request of a micro-batch and written back after the last, so a shard holds its
    ``room`` and one batch of requests, however many there are. A new key for which there is no room drops windows
    that are over, then the oldest.
    """

    def __init__(self, most: int, seconds: float, room: int, ttl: int | None):
        self.most, self.seconds, self.room, self.ttl = most, seconds, room, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "key string", "start double, used int", ttlDurationMs=self.ttl and self.ttl * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        there = self.windows.iterator() if self.windows.exists() else ()
        before = dict(sorted(((k[0], tuple(v)) for k, v in there), key=lambda x: x[1][0]))
        held = dict(before)  # in the order in which windows began
        for frame in rows:
            frame = frame.sort_values("ts", kind="stable")
            allowed = [self.check(held, k, t.timestamp()) for k, t in zip(frame["key"], frame.ts, strict=True)]
            yield pd.DataFrame({"key": frame["key"], "ts": frame.ts, "allowed": allowed})
        for k in before.keys() - held.keys():
            self.windows.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.windows.updateValue((k,), v)

    def check(self, held: dict[str, tuple[float, int]], key: str, now: float) -> bool:
        start, used = held.get(key, (None, 0))
        if start is not None and now - start < self.seconds:
            if used >= self.most:
                return False
            held[key] = (start, used + 1)
            return True
        held.pop(key, None)
        while len(held) >= self.room:
            oldest = next(iter(held))
            if now - held[oldest][0] >= self.seconds:
                for k in [k for k, (at, _) in held.items() if now - at >= self.seconds]:
                    del held[k]
            else:
                del held[oldest]
        held[key] = (now, 1)
        return True

    def close(self) -> None:
        pass


def limited(requests: DataFrame, most: int = 30, seconds: int = 10, most_keys: int = 10_000, shards: int = 8, ttl: int | None = None) -> DataFrame:
    """Requests (key, ts) of a stream with ``allowed``; at most ``most_keys`` keys are remembered, dealt over ``shards``.

    A key's window begins with its first request after the last one ended, and ``most`` pass in it. Requests are taken as
    they come; one that comes late counts in the window that is open. With ``ttl`` a key that didn't ask for so many seconds
    of the clock is forgotten; as time goes on without data, such a stream does not end by itself (no availableNow). Start
    the stream inside ``pile_on.keyed_state``, in append or update mode.
    """
    if most_keys < shards:
        raise ValueError("each shard needs room for a key")
    rows = requests.where("key is not null and ts is not null").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), F.col("key").cast("string").alias("key"), "ts")
    return rows.groupBy("shard").transformWithStateInPandas(Limiter(most, seconds, most_keys // shards, ttl), "key string, ts timestamp, allowed boolean", "append", "none" if ttl is None else "processingTime")


def limited_batch(requests: DataFrame, most: int = 30, seconds: int = 10) -> DataFrame:
    """The same over a table, in one pass over each key's sorted requests; what a key has done so far is all that is held."""
    held = [f for f in requests.schema.fields if f.name in ("key", "ts")]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(held, key=lambda f: f.name)) + ", allowed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, used = None, None, 0
        for rows in frames:
            ok: list[bool] = []
            for key, part in rows.groupby("key", sort=False, dropna=False):
                if key != last:
                    last, start, used = key, None, 0
                got, start, used = allow([t.timestamp() for t in part.ts], start, used, most, seconds)
                ok += got
            yield rows.assign(allowed=ok)

    rows = requests.select("key", "ts").where("key is not null and ts is not null").repartition("key").sortWithinPartitions("key", "ts")
    return rows.mapInPandas(run, out)


def distinct_events(stream: DataFrame, late: str = "1 day") -> DataFrame:
    key = event_key(F.col("event_type"), F.col("amplifier").cast("string"), F.col("post").cast("string"), F.col("uri"))
    return stream.withColumn("key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def fill_queue(stream: DataFrame, store: Store, name: str, keys: list[str], checkpoint: str):
    """Each micro-batch is queued as a delta, and again without harm if it is replayed: finished rows keep their verdicts."""

    def each(rows: DataFrame, _: int) -> None:
        queue.push(store, name, rows, keys)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
