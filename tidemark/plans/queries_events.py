"""Queries over events, the follow graph and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import graph
from .base import EVENTS, FOLLOWS, events, follows, table
from .registry import query

EV, FO = "WITH " + EVENTS, "WITH " + FOLLOWS


PILED = "SELECT DISTINCT b.amplifier FROM {0} b JOIN (SELECT a.post, a.t FROM (SELECT DISTINCT post, t FROM {0}) a JOIN {0} c ON c.post = a.post AND c.t BETWEEN a.t - 86400 AND a.t GROUP BY a.post, a.t HAVING count(DISTINCT c.amplifier) >= 5) e ON b.post = e.post AND b.t BETWEEN e.t - 86400 AND e.t"


@query(EV + " " + PILED.format("ev"))
def pile_on_participants(spark, sf_dir):
    return E.pile_on(events(spark, sf_dir))


@query(EV + " SELECT event_id, amplifier, post, event_type FROM ev ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    return E.recent(events(spark, sf_dir), 50).select("event_id", "amplifier", "post", "event_type")


@query(EV + " SELECT min(event_id) AS event_id FROM ev GROUP BY CASE WHEN event_type = 'like' THEN amplifier || '|' || post ELSE CAST(event_id % 3000 AS VARCHAR) END")
def event_dedup(spark, sf_dir):
    e = events(spark, sf_dir)
    key = E.event_key(F.col("event_type"), F.col("amplifier").cast("string"), F.col("post").cast("string"), (F.col("event_id") % 3000).cast("string"))
    return E.first_of(e.withColumn("key", key), ["key"], ["event_id"]).select("event_id")


@query(EV + " SELECT amplifier, post, min(event_id) AS event_id FROM ev WHERE event_type = 'like' GROUP BY amplifier, post")
def liker_dedup(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'like'")
    return E.first_of(e, ["amplifier", "post"], ["event_id"]).select("amplifier", "post", "event_id")


@query(EV + " SELECT event_id, event_type FROM ev WHERE amplifier = 7 ORDER BY ts DESC, event_id DESC")
def events_by_amplifier(spark, sf_dir):
    return events(spark, sf_dir).where("amplifier = 7").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")


@query(EV + " SELECT count(DISTINCT amplifier) AS amplifiers, count(*) FILTER (event_type IN ('quote', 'reply')) AS with_text FROM ev")
def amplifier_counts(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count_distinct("amplifier").alias("amplifiers"), F.count_if(F.col("event_type").isin("quote", "reply")).alias("with_text"))


@query(EV + " SELECT amplifier, arg_min(event_type, event_id) AS first_type FROM ev GROUP BY amplifier")
def distinct_amplifiers(spark, sf_dir):
    return events(spark, sf_dir).groupBy("amplifier").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query(EV + " SELECT amplifier, post, event_type, count(*) AS n FROM (SELECT * FROM ev WHERE event_type = 'quote' UNION ALL SELECT * FROM ev WHERE event_type = 'repost') GROUP BY 1, 2, 3")
def quote_repost_union(spark, sf_dir):
    e = events(spark, sf_dir)
    both = e.where("event_type = 'quote'").unionByName(e.where("event_type = 'repost'"))
    return both.groupBy("amplifier", "post", "event_type").agg(F.count("*").alias("n"))


@query(EV + " SELECT e.event_id, d.n_chars AS original_chars FROM ev e LEFT JOIN documents d ON e.post = d.doc_id")
def event_originals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), F.col("n_chars").alias("original_chars"))
    return events(spark, sf_dir).join(d, "post", "left").select("event_id", "original_chars")


@query(EV + ", u AS (SELECT DISTINCT amplifier AS account FROM ev WHERE event_type = 'quote'), l AS (SELECT DISTINCT amplifier AS account FROM ev WHERE event_type = 'like') SELECT account, 'quote' AS via FROM u UNION ALL SELECT account, 'like' FROM l WHERE account NOT IN (SELECT account FROM u)")
def candidate_precedence(spark, sf_dir):
    e = events(spark, sf_dir)
    pick = lambda kind: e.where(F.col("event_type") == kind).select(F.col("amplifier").alias("account"), F.lit(kind).alias("via")).distinct()
    return E.by_precedence(pick("quote"), pick("like"), "account")


@query(EV + ", c AS (SELECT t AS ts, 1 AS d FROM ev UNION ALL SELECT t + 600, -1 FROM ev), g AS (SELECT ts, sum(d) AS d FROM c GROUP BY ts), r AS (SELECT sum(d) OVER (ORDER BY ts) AS n, lead(ts) OVER (ORDER BY ts) - ts AS dt FROM g) SELECT CAST(sum(least(n, 3) * dt) AS BIGINT) AS worker_seconds FROM r")
def worker_seconds(spark, sf_dir):
    t = events(spark, sf_dir).select(F.unix_timestamp("ts").alias("ts"))
    changes = t.withColumn("delta", F.lit(1)).unionByName(t.select((F.col("ts") + 600).alias("ts"), F.lit(-1).alias("delta")))
    return E.worker_seconds(changes, 3)


@query(EV + ", s AS (SELECT amplifier, event_id, event_type = 'quote' AS f, lag(event_type = 'quote') OVER (PARTITION BY amplifier ORDER BY event_id) AS b FROM ev) SELECT amplifier, event_id, CASE WHEN f THEN 'rise' ELSE 'fall' END AS edge FROM s WHERE f <> coalesce(b, FALSE)")
def flag_edges(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("f", F.col("event_type") == "quote")
    return E.edges_of_change(e, "amplifier", "event_id", "f").select("amplifier", "event_id", "edge")


@query(EV + ", s AS (SELECT amplifier AS account_id, max(ts) AS scored_at FROM ev WHERE event_id % 2 = 0 GROUP BY 1) SELECT DISTINCT amplifier AS account_id FROM ev WHERE amplifier NOT IN (SELECT account_id FROM s WHERE scored_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY)")
def stale_accounts(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("amplifier", "account_id")
    s = e.where("event_id % 2 = 0").groupBy("account_id").agg(F.max("ts").alias("scored_at"))
    return graph.stale(e.select("account_id").distinct(), s, "2024-01-30 00:00:00", 1)


@query(EV + ", s AS (SELECT amplifier AS account_id, max(ts) AS scored_at FROM ev WHERE event_id % 2 = 0 GROUP BY 1) SELECT account_id FROM s WHERE scored_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY")
def fresh_accounts(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("amplifier", "account_id")
    s = e.where("event_id % 2 = 0").groupBy("account_id").agg(F.max("ts").alias("scored_at"))
    return s.join(graph.stale(s, s, "2024-01-30 00:00:00", 1), "account_id", "left_anti").select("account_id")


@query(FO + ", a AS (SELECT DISTINCT src AS account_id FROM follows), o AS (SELECT dst FROM follows WHERE src = 1), i AS (SELECT src FROM follows WHERE dst = 1) SELECT account_id, CASE WHEN account_id IN (SELECT dst FROM o) AND account_id IN (SELECT src FROM i) THEN 'Mutual follow' WHEN account_id IN (SELECT src FROM i) THEN 'Follows you' WHEN account_id IN (SELECT dst FROM o) THEN 'You follow' ELSE 'Stranger' END AS graph_distance FROM a")
def graph_distance(spark, sf_dir):
    f = follows(spark, sf_dir)
    return graph.distance(f.select(F.col("src").alias("account_id")).distinct(), f, 1)


@query(FO + ", a AS (SELECT src FROM follows WHERE dst = 1) SELECT DISTINCT src AS account_id FROM follows WHERE dst IN (SELECT src FROM a) AND src <> 1 AND src NOT IN (SELECT src FROM a)")
def second_degree(spark, sf_dir):
    return graph.second_degree(follows(spark, sf_dir), 1)


@query(FO + " SELECT DISTINCT src AS account_id FROM follows WHERE src <> 1 AND src NOT IN (SELECT dst FROM follows WHERE src = 1)")
def drive_by_repliers(spark, sf_dir):
    f = follows(spark, sf_dir)
    return graph.drive_by(f.select(F.col("src").alias("account_id")).distinct(), f, 1)


@query(FO + ", d AS (SELECT DISTINCT src FROM follows WHERE src <> 1 AND src NOT IN (SELECT dst FROM follows WHERE src = 1)) SELECT o_orderkey FROM orders WHERE o_custkey % 200 IN (SELECT src FROM d)")
def drive_by_rows(spark, sf_dir):
    f = follows(spark, sf_dir)
    d = graph.drive_by(f.select(F.col("src").alias("account_id")).distinct(), f, 1)
    o = table(spark, sf_dir, "orders").withColumn("account_id", F.col("o_custkey") % 200)
    return o.join(d, "account_id", "left_semi").select("o_orderkey")


@query(FO + " SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM follows) WHERE n <= 10")
def followers_capped(spark, sf_dir):
    w = Window.partitionBy("dst").orderBy("src")
    return follows(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 10").select("src", "dst")


@query(FO + ", p AS (SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey % 3 <> 0) SELECT DISTINCT dst AS account_id, coalesce(c_name, CAST(dst AS VARCHAR)) AS handle FROM follows LEFT JOIN p ON dst = id")
def handles_resolved(spark, sf_dir):
    p = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("dst"), "c_name")
    d = follows(spark, sf_dir).select("dst").distinct()
    return d.join(p, "dst", "left").select(F.col("dst").alias("account_id"), F.coalesce("c_name", F.col("dst").cast("string")).alias("handle"))


@query(EV + " SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM ev) WHERE n <= 100 / 4 + 1")
def budget_split(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("event_id")
    return events(spark, sf_dir).withColumn("n", F.row_number().over(w)).where(F.col("n") <= 100 // 4 + 1).select("event_type", "event_id")


@query("SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def user_overview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("spent"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))
