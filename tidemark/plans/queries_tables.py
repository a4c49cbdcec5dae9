"""Queries over the upsert, queue and lookup operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import store
from ..sources.scratch import shared_dir
from .base import table
from .registry import query


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 3 = 0")
def upsert_rows(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changed = old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new"))
    new = changed.unionByName(changed.withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return store.upsert(old, new, ["c_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS score, CASE WHEN o_orderstatus = 'F' THEN TRUE END AS toxic_token FROM orders")
def queue_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    old = o.select("o_orderkey", F.when(done, "done").otherwise("pending").alias("status"), F.col("o_totalprice").alias("score"), F.when(done, True).alias("toxic_token"))
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("pending").alias("status"), F.lit(0.0).alias("score"), F.lit(None).cast("boolean").alias("toxic_token"))
    return store.enqueue(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 2 = 0 END AS toxic_token FROM orders")
def record_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    queue = o.select("o_orderkey", F.lit("pending").alias("status"), F.lit(None).cast("boolean").alias("toxic_token"))
    verdicts = o.where("o_orderkey % 4 = 0").select("o_orderkey", (F.col("o_custkey") % 2 == 0).alias("toxic_token"))
    return store.record_verdicts(queue, verdicts, ["o_orderkey"])


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_update(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("ignored").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return store.update_columns(s, new, ["s_suppkey"], ["s_acctbal"])


@query("SELECT row_number() OVER (ORDER BY o_orderkey) + 500 AS id, o_orderkey FROM orders")
def batch_append_ids(spark, sf_dir):
    return store.with_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "id", 500, shared_dir(spark) + "/ids")


@query("SELECT * FROM nation WHERE NOT (n_regionkey = 2)")
def cascade_delete(spark, sf_dir):
    """The rows of user 2 go from two tables of a store, in one commit; what is left of one of them."""
    s = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    owned = table(spark, sf_dir, "nation").withColumn("user_id", F.col("n_regionkey").cast("string"))
    s.replace_all({"nations": owned, "regions": table(spark, sf_dir, "region").withColumn("user_id", F.col("r_regionkey").cast("string"))})
    s.delete_user("2", ["nations", "regions", "not there"])
    left = s.read("regions").select("user_id")
    return s.read("nations").join(left, "user_id", "left_semi").drop("user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042') LIMIT 1")
def account_by_handle(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.lower("c_name") == "customer#000000042").select("c_custkey", "c_name").limit(1)


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(DISTINCT o_custkey) AS accounts, count(*) > 0 AS any FROM orders")
def queue_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_distinct("o_custkey").alias("accounts"), (F.count("*") > 0).alias("any"))


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS id, l_orderkey, l_linenumber FROM lineitem")
def append_wide_rows(spark, sf_dir):
    """Whole rows appended in two parts: the second's ids go on from the first's."""
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    half = rows.agg(F.percentile_approx("key", 0.5)).first()[0]
    s = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    s.append("lines", rows.where(F.col("key") <= half), "key", "id")
    got = s.append("lines", rows.where(F.col("key") > half), "key", "id")
    return got.select("id", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE)::VARCHAR AS skipped_on FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def skips_newest_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return o.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("skipped_on"))


@query("SELECT * FROM (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey <> 7) UNION ALL SELECT c_custkey, 'paired anew', c_nationkey FROM customer WHERE c_nationkey = 7 AND c_custkey % 2 = 0")
def pairs_of_one_target_replaced(spark, sf_dir):
    """All pairs of a target go, and its new ones come, in one commit."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    s = store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    s.replace("pairs", c)
    return s.replace_rows("pairs", c.where("c_nationkey = 7 and c_custkey % 2 = 0").withColumn("c_name", F.lit("paired anew")), c_nationkey=7)


@query("SELECT 'account_scores' AS name, count(*) FILTER (c_acctbal >= 0) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def store_copied(spark, sf_dir):
    a, b = (store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}") for _ in range(2))
    a.replace_all({"account_scores": table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("score")), "events": table(spark, sf_dir, "events")})
    a.copy_to(b, ["account_scores", "events", "labels"])
    return b.read("account_scores").agg(F.lit("account_scores").alias("name"), F.count("*").alias("n")).unionByName(b.read("events").agg(F.lit("events").alias("name"), F.count("*").alias("n")))
