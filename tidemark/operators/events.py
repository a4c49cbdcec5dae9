"""Amplification events: pile-ons, deduplication, ranked reads. events: amplifier, post, event_type, ts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
LEAST = 5


def pile_on(events: DataFrame, seconds: int = DAY, least: int = LEAST) -> DataFrame:
    """Distinct amplifiers that stand in a span of ``seconds`` (inclusive) with ``least`` distinct amplifiers on one post.

    At any moment an amplifier counts from its latest event on, until its next
    event takes over or ``seconds`` have passed. These intervals are cut at the
    borders of time buckets, and one sorted pass over each (post, bucket) counts
    those that are open, so a hot post is spread over its buckets and the work
    grows with the events, not with their pairs.
    """
    e = events.select("post", "amplifier", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t")).where("t is not null").distinct()
    following = F.lead("t").over(Window.partitionBy("post", "amplifier").orderBy("t"))
    e = e.withColumn("last", F.least(following - 1, F.col("t") + seconds))
    bucket = F.explode(F.sequence(F.floor(F.col("t") / seconds), F.floor(F.col("last") / seconds)))
    cut = e.withColumn("bucket", bucket).select(
        "post", "bucket", "amplifier", F.greatest("t", F.col("bucket") * seconds).alias("lo"), F.least("last", (F.col("bucket") + 1) * seconds - 1).alias("hi")
    )
    marks = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).alias("d"))))
    rows = cut.select("post", "bucket", "amplifier", "lo", marks.alias("m")).select("post", "bucket", "amplifier", "lo", "m.at", "m.d")
    w = Window.partitionBy("post", "bucket").orderBy("at")
    open_now = F.sum("d").over(w.rangeBetween(Window.unboundedPreceding, 0))
    crowded = F.max(F.when(F.col("n") >= least, F.col("at"))).over(w.rangeBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("n", open_now).withColumn("crowded", crowded)
    return seen.where((F.col("d") == -1) & (F.col("crowded") >= F.col("lo"))).select("amplifier").distinct()


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def event_key(kind: Column, amplifier: Column, original: Column, uri: Column) -> Column:
    """Likes are one for each person and post; everything else has an address of its own."""
    return F.when(kind == "like", F.concat_ws("|", amplifier, original)).otherwise(uri)


def recent(events: DataFrame, n: int, at_most: int = 500) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(n, at_most))


def by_precedence(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Union in which the row of ``preferred`` wins."""
    both = preferred.withColumn("_p", F.lit(0)).unionByName(other.withColumn("_p", F.lit(1)))
    return first_of(both, [key], ["_p"]).drop("_p")


def worker_seconds(changes: DataFrame, most: int, key: str | None = None, width: int = DAY) -> DataFrame:
    """Integral over time of min(running, most). changes: ts (seconds), delta (+1 enter, -1 leave).

    Time is cut in buckets of ``width``. What runs when a bucket begins, and when
    the next change after it is, follow from one row a bucket, so a bucket is
    summed by itself and no task sorts all changes. Changes are shuffled once, by bucket:
    sums by moment, by bucket and along a bucket all find them where they are.
    """
    keys = [key] if key else []
    dealt = changes.select(*keys, "ts", "delta", F.floor(F.col("ts") / width).alias("_b")).repartition(*keys, "_b")
    per = dealt.groupBy(*keys, "_b", "ts").agg(F.sum("delta").alias("delta"))
    over = Window.partitionBy(*keys).orderBy("_b")
    buckets = per.groupBy(*keys, "_b").agg(F.sum("delta").alias("_d"), F.min("ts").alias("_first"))
    before = F.coalesce(F.sum("_d").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select(*keys, "_b", before.alias("_before"), F.lead("_first").over(over).alias("_next"))
    w = Window.partitionBy(*keys, "_b").orderBy("ts")
    running = F.col("_before") + F.sum("delta").over(w)
    dt = F.coalesce(F.lead("ts").over(w), F.col("_next")) - F.col("ts")
    spans = per.join(buckets, [*keys, "_b"]).select(*keys, running.alias("running"), dt.alias("dt"))
    return spans.groupBy(*keys).agg(F.coalesce(F.sum(F.least("running", F.lit(most)) * F.col("dt")), F.lit(0)).alias("worker_seconds"))


def edges_of_change(samples: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Where a flag rises or falls."""
    before = F.lag(flag).over(Window.partitionBy(key).orderBy(order))
    seen = samples.withColumn("_before", F.coalesce(before, F.lit(False)))
    edge = F.when(F.col(flag) & ~F.col("_before"), "rise").when(~F.col(flag) & F.col("_before"), "fall")
    return seen.withColumn("edge", edge).where("edge is not null").drop("_before")
