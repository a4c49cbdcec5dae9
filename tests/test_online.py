"""Streams against the same over a table: events in shuffled micro-batches, more keys than there is room for."""

import random
import sys
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.streaming import limits, pile_on

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DAY0 = datetime(2024, 1, 1, tzinfo=UTC)


def streamed(spark, df, files, folder, step, mode="append"):
    """All rows of a stream over ``df`` dealt into files, one a micro-batch."""
    df.repartition(files).write.parquet(f"{folder}/in")
    stream = step(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    with pile_on.keyed_state(spark):
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_participants_by_every_span():
    rng = random.Random(1)
    for _ in range(300):
        ev = [(rng.randrange(60), rng.randrange(6)) for _ in range(rng.randrange(1, 25))]
        spans = [{a for t, a in ev if x <= t <= x + 10} for x in range(-10, 60)]
        want = set().union(*[s for s in spans if len(s) >= 4], set())
        assert pile_on.participants(np.array([t for t, _ in ev]), [a for _, a in ev], 10, 4) == want


@pytest.mark.parametrize("files", [1, 5])
def test_online_pile_on(spark, tmp_path, files):
    """A hot post, posts near the limit, repeated events, nulls; each participant of a bucket is told once."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, *range(2, 9)]), rng.randrange(12), DAY0 + timedelta(seconds=rng.randrange(0, 4000))) for _ in range(250)]
    rows += rows[:10] + [(None, 1, DAY0), (3, None, DAY0), (3, 4, None)]
    df = spark.createDataFrame(rows, "post long, amplifier long, ts timestamp")
    got = streamed(spark, df, files, f"file://{tmp_path}", lambda s: pile_on.online(s, "1 day", seconds=300, least=4))
    want = {r.amplifier for r in E.pile_on(df.where("post is not null"), 300, 4).where("amplifier is not null").collect()}
    told = [(r.post, r.amplifier) for r in got.collect()]
    assert {a for _, a in told} == want and want
    assert files > 1 or max(map(told.count, told)) <= 2 * 4000 / 300


def test_state_of_the_past_is_dropped(spark, tmp_path):
    """When the watermark has passed a bucket nothing of it is kept."""
    rows = [(1, a, DAY0 + timedelta(hours=h)) for h in range(40) for a in range(5)]
    df = spark.createDataFrame(rows, "post long, amplifier long, ts timestamp")
    ordered = df.repartitionByRange(8, "ts")
    got = streamed(spark, ordered.sortWithinPartitions("ts"), 8, f"file://{tmp_path}", lambda s: pile_on.online(s, "1 second", seconds=600, least=5))
    assert got.select("amplifier").distinct().count() == 5
    left = spark.read.format("statestore").option("stateVarName", "events").load(f"file://{tmp_path}/state")
    assert left.count() <= 20  # two buckets of the last hour


def test_limiter_over_a_stream_is_that_over_a_table(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted({(DAY0 + timedelta(milliseconds=rng.randrange(60_000)), f"k{rng.randrange(5)}") for _ in range(300)})
    df = spark.createDataFrame([(k, t) for t, k in rows], "key string, ts timestamp")
    got = streamed(spark, df, 1, f"file://{tmp_path}", lambda s: limits.limited(s, 3, 10))
    key = lambda d: sorted((r.key, r.ts, r.allowed) for r in d.collect())
    assert key(got) == key(limits.limited_batch(df, 3, 10))


def test_remembered_keys_are_bounded(spark, tmp_path):
    """Ten times as many keys as there is room for: state stays below the bound; nobody new is turned away."""
    df = spark.range(400).select(F.concat(F.lit("k"), F.col("id") % 200).alias("key"), (F.lit(DAY0) + F.make_dt_interval(secs=F.col("id") / 100)).alias("ts"))
    got = streamed(spark, df, 3, f"file://{tmp_path}", lambda s: limits.limited(s, 30, 10, most_keys=20, shards=4))
    assert got.count() == 400 and got.where("allowed").count() == 400
    left = spark.read.format("statestore").option("stateVarName", "windows").load(f"file://{tmp_path}/state")
    assert 0 < left.count() <= 20


def test_keys_are_forgotten_in_time(spark, tmp_path):
    """With a ttl of a second, a key that comes back later finds nothing of itself, whatever its requests' times say."""
    schema, folder = "key string, ts timestamp", f"file://{tmp_path}"
    put = lambda n: spark.createDataFrame([("k", DAY0)] * 2, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    put(0)
    stream = limits.limited(spark.readStream.schema(schema).parquet(f"{folder}/in"), 2, 10, shards=1, ttl=1)
    with pile_on.keyed_state(spark):
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start()
    def seen(n):
        for _ in range(150):
            done = sum(p.numInputRows for p in q.recentProgress)
            if done >= n:
                return
            time.sleep(0.2)
        raise TimeoutError(q.status)

    try:
        seen(2)
        time.sleep(2)
        put(1)
        seen(4)
    finally:
        q.stop()
    assert [r.allowed for r in spark.read.parquet(f"{folder}/out").collect()] == [True] * 4


def test_limiter_decides_as_one_map():
    """Windows reset, keys are independent, eviction drops what is over before what is oldest."""
    one = limits.Limiter(2, 10, 3, 60)
    held = {}
    assert [one.check(held, "a", t) for t in (0, 1, 2, 9.9, 10, 11, 12)] == [True, True, False, False, True, True, False]
    assert one.check(held, "b", 12) and one.check(held, "c", 13) and one.check(held, "d", 14)
    assert list(held) == ["b", "c", "d"]
    assert one.check(held, "e", 22.5) and list(held) == ["c", "d", "e"]
