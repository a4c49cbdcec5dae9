"""The limiter over a table: windows that begin with a key's first hit."""

from datetime import UTC, datetime

from tidemark.streaming import limits


def test_limited_batch(spark):
    at = [0, 1, 2, 9, 10, 11, 30]
    rows = [(k, datetime.fromtimestamp(t, UTC)) for k in ("a", "b") for t in at]
    got = limits.limited_batch(spark.createDataFrame(rows, "key string, ts timestamp"), 2, 10).orderBy("key", "ts").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, True] * 2
    assert limits.limited_batch(spark.createDataFrame([], "key string, ts timestamp")).count() == 0


def test_worker_seconds_over_buckets(spark):
    """Changes in one bucket, over empty buckets, and at the same moment; against a loop."""
    from tidemark.operators import events

    rows = [(0, 1), (5, 1), (5, 1), (9, -1), (10, 1), (25, -1), (47, -1), (50, -1), (60, 0)]
    want, run = 0, 0
    for (t, d), (after, _) in zip(rows, rows[1:], strict=False):
        run += d
        want += min(run, 2) * (after - t)
    df = spark.createDataFrame(rows, "ts long, delta int")
    assert [events.worker_seconds(df, 2, width=w).first()[0] for w in (10, 7, 1000)] == [want] * 3
    assert events.worker_seconds(df.where("false"), 2).first()[0] == 0
