"""The driver's tables as the engine's: posts, events, follows, vectors.

Each has the same rule in Spark and in SQL. An account is a source of
documents, a document is a post; its kind follows from its id; labels say which
posts are toxic; an event's amplifier is its user and its post the number in
its properties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["original", "reply", "quote"]
EVENT_KINDS = {"signup": "quote", "error": "repost", "click": "like", "view": "reply", "purchase": "quote"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # noqa: E741
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.join(l, "doc_id", "left").select(
        F.col("source").alias("account_id"),
        F.col("doc_id").alias("uri"),
        F.col("doc_id").alias("seq"),
        "text",
        F.array("lang").alias("langs"),
        "lang",
        kind.alias("post_kind"),
        F.when(F.col("doc_id") % 3 == 1, F.col("doc_id") - 1).alias("parent_uri"),
        (F.col("n_chars") % 50).alias("likes"),
        (F.col("n_chars") % 7).alias("reposts"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_toxic"),
        ((F.col("doc_id") * 37 % 100) / 100.0).alias("score"),
    )


POSTS = """posts AS (
  SELECT d.source AS account_id, d.doc_id AS uri, d.doc_id AS seq, d.text, d.lang,
    CASE d.doc_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'reply' ELSE 'quote' END AS post_kind,
    CASE WHEN d.doc_id % 3 = 1 THEN d.doc_id - 1 END AS parent_uri,
    d.n_chars % 50 AS likes, d.n_chars % 7 AS reposts, coalesce(l.toxic, 0) = 1 AS is_toxic,
    (d.doc_id * 37 % 100) / 100.0::DOUBLE AS score
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("amplifier"),
        F.get_json_object("props", "$.k").cast("long").alias("post"),
        kind.alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )


EVENTS = """ev AS (
  SELECT event_id, user_id AS amplifier, CAST(props->>'$.k' AS BIGINT) AS post,
    CASE event_type WHEN 'signup' THEN 'quote' WHEN 'error' THEN 'repost' WHEN 'click' THEN 'like' WHEN 'view' THEN 'reply' ELSE 'quote' END AS event_type,
    ts, value, CAST(floor(epoch(ts)) AS BIGINT) AS t
  FROM events
)"""


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 200).alias("src"), (F.col("o_orderkey") * 7 % 200).alias("dst")).where("src <> dst").distinct()


FOLLOWS = """follows AS (
  SELECT DISTINCT o_custkey % 200 AS src, o_orderkey * 7 % 200 AS dst FROM orders WHERE o_custkey % 200 <> o_orderkey * 7 % 200
)"""
