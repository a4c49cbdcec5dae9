"""Queries over discovery, service state, records and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, service, text
from ..operators import discovery, topics
from ..operators import posts as P
from ..sources import records
from ..streaming import limits
from .base import EVENTS, POSTS, events, posts, table
from .registry import query
from .queries_scalar import ITEMS, items

EV = "WITH " + EVENTS


def links(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("post").alias("subject"), F.col("event_type").alias("source"), F.col("amplifier").alias("author"), F.col("event_id").alias("seq"))


@query(EV + " SELECT post AS subject, event_type AS source, amplifier AS author, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY post, event_type ORDER BY event_id DESC) AS n FROM ev) WHERE n <= 3")
def backlinks_capped(spark, sf_dir):
    return discovery.backlinks(links(spark, sf_dir), 3)


@query(EV + " SELECT event_id AS seq, post AS subject, amplifier AS author, event_type || 'd' AS event_type FROM ev WHERE event_type IN ('quote', 'like') AND post IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def amplification_scan(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").where("n_chars > 500").select(F.col("doc_id").alias("uri"))
    return discovery.amplification(wanted, links(spark, sf_dir), {"quote": "quoted", "like": "liked"}).select("seq", "subject", "author", "event_type")


@query("WITH " + POSTS + " SELECT account_id, min(seq) AS first_seq FROM posts WHERE contains(lower(text), 'license') GROUP BY account_id ORDER BY first_seq, account_id LIMIT 10")
def author_search(spark, sf_dir):
    return discovery.authors(posts(spark, sf_dir), "License", 10)


@query("WITH " + POSTS + " SELECT DISTINCT account_id FROM posts WHERE lang = 'en' AND account_id NOT IN (SELECT account_id FROM posts WHERE is_toxic)")
def unscored_authors(spark, sf_dir):
    p = posts(spark, sf_dir)
    return discovery.unscored(p.where("lang = 'en'"), p.where("is_toxic"))


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS purpose, count(c_custkey) AS members FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2 HAVING count(c_custkey) >= 2 AND n_name <= 'NATION_19'")
def list_search(spark, sf_dir):
    sized = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("members"))
    rows = table(spark, sf_dir, "nation").join(sized, "n_nationkey").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("purpose"), "members")
    return discovery.lists(rows.where("name <= 'NATION_19'"), members=2, pattern="^[A-Z]")


@query("WITH " + POSTS + ", f AS (SELECT * FROM posts WHERE length(text) >= 40 AND regexp_matches(text, '[a-z]{3}')), u AS (SELECT account_id, text, seq FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY seq) AS n FROM f) WHERE n = 1) SELECT account_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS n FROM u) WHERE n <= 7")
def harvested_posts(spark, sf_dir):
    return discovery.harvest(posts(spark, sf_dir), 40, "[a-z]{3}", 7).select("account_id", "seq")


RAW = "CASE c_custkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Elevated' WHEN 2 THEN 'watch' WHEN 3 THEN 'Safe' ELSE 'other' END"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN lower({RAW}) END AS label FROM customer")
def label_whitelist(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", service.user_label(F.expr(RAW)).alias("label"))


@query(EV + " SELECT event_id, CASE WHEN event_type = 'repost' THEN post ELSE event_id END AS shown FROM ev")
def event_projection(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "repost", F.col("post")).otherwise(F.col("event_id")).alias("shown"))


@query("SELECT s_suppkey AS account_id, count(ps) AS posts, count(ps) > 0 AS scored FROM supplier LEFT JOIN (SELECT l_suppkey, 1 AS ps FROM lineitem WHERE l_quantity = 1) ON s_suppkey = l_suppkey GROUP BY 1")
def account_stub(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem").where("l_quantity = 1").groupBy("l_suppkey").agg(F.count("*").alias("posts"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account_id"))
    return asked.join(known, asked["account_id"] == known["l_suppkey"], "left").select("account_id", F.coalesce("posts", F.lit(0)).alias("posts"), F.col("posts").isNotNull().alias("scored"))


@query("SELECT l_orderkey, round(avg(CASE WHEN l_tax > 0.02 THEN l_quantity / 50 END), 6) AS context FROM lineitem GROUP BY l_orderkey")
def context_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_quantity") / 50)), 6).alias("context"))


STATE = "CASE o_orderkey % 4 WHEN 0 THEN 'gather' WHEN 1 THEN 'burst' WHEN 2 THEN 'finalize' ELSE 'done' END"
SHOWN = f"CASE WHEN o_custkey % 3 <> 0 AND o_orderstatus = 'O' THEN CASE {STATE} WHEN 'gather' THEN 'gathering' WHEN 'burst' THEN 'classifying' WHEN 'finalize' THEN 'finalizing' ELSE 'scoring' END WHEN o_orderstatus = 'O' THEN 'scoring' ELSE 'discovering' END"


@query(f"WITH s AS (SELECT o_orderkey, {SHOWN} AS shown, o_custkey FROM orders) SELECT o_orderkey, shown, CASE shown WHEN 'discovering' THEN 1 WHEN 'finalizing' THEN 3 ELSE 2 END AS step, CASE WHEN shown IN ('classifying', 'finalizing') THEN greatest(500 - o_custkey, 0) END AS classified FROM s")
def scan_phase(spark, sf_dir):
    phase = F.when(F.col("o_orderstatus") == "O", "scoring").otherwise("discovering")
    s = table(spark, sf_dir, "orders").withColumn("shown", service.shown_phase(phase, F.col("o_custkey") % 3 != 0, F.expr(STATE)))
    return s.select("o_orderkey", "shown", service.step_index(F.col("shown")).alias("step"), service.classified(F.col("shown"), F.lit(500), F.col("o_custkey")).alias("classified"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 OR o_custkey % 7 = 0 OR o_custkey % 11 = 0 THEN 'results' WHEN o_orderstatus = 'F' THEN 'all-clear' ELSE 'welcome' END AS shown FROM orders")
def dashboard_view(spark, sf_dir):
    c = F.col("o_custkey")
    started = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    view = service.dashboard(c % 5 == 0, F.when(c % 7 == 0, 3).otherwise(0), F.when(c % 11 == 0, 1).otherwise(0), started)
    return table(spark, sf_dir, "orders").select("o_orderkey", view.alias("shown"))


@query("SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) IN ('1', '2', '3') AS allowed, FALSE AS admin, CASE WHEN n_regionkey <> 1 THEN CAST(n_nationkey AS VARCHAR) WHEN n_nationkey IN (1, 2, 3) THEN '9' END AS effective FROM nation")
def access_lists(spark, sf_dir):
    did = F.col("n_nationkey").cast("string")
    named = service.admin(did, F.lit("1, 2,3 "))
    other = F.when(F.col("n_regionkey") == 1, "9")
    return table(spark, sf_dir, "nation").select("n_nationkey", service.allowed(did, F.lit("1, 2,3 ")).alias("allowed"), service.admin(did, F.lit("")).alias("admin"), service.effective_user(did, named, other).alias("effective"))


@query("SELECT o_orderkey, o_custkey % 2 = 0 OR o_custkey % 3 = 0 AS results, o_custkey % 3 = 0 AND o_custkey % 2 <> 0 AS accuracy FROM orders")
def poll_actions(spark, sf_dir):
    p = service.polls(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", p["results"].alias("results"), p["accuracy"].alias("accuracy"))


@query("WITH " + POSTS + ", g AS (SELECT account_id, count(*) FILTER (post_kind = 'original') AS o, count(*) AS n, count(*) FILTER (is_toxic) = 0 AS early FROM posts GROUP BY 1) SELECT account_id, CASE WHEN early THEN 'low' WHEN o >= 15 THEN 'high' ELSE 'standard' END AS confidence, CASE WHEN early THEN 3 WHEN o >= 15 THEN 14 ELSE 7 END AS days FROM g")
def confidence_days(spark, sf_dir):
    r = P.ratios(posts(spark, sf_dir)).withColumn("quality", scoring.fingerprint_quality(F.col("n_original"), F.col("n_reply") + F.col("n_quote")))
    toxic = posts(spark, sf_dir).groupBy("account_id").agg((F.count_if("is_toxic") == 0).alias("early"))
    level = scoring.confidence(F.col("quality"), F.col("early"))
    return r.join(toxic, "account_id").select("account_id", level.alias("confidence"), scoring.stale_days(level).alias("days"))


@query(ITEMS + "SELECT l_orderkey, l_linenumber, t <= 0.5 AS valid, CASE WHEN t <= 0.5 THEN o >= 0.5 AND l_returnflag = 'R' ELSE NULL END AS toxic, round(exp(-c), 6) AS level FROM i")
def verdict_slots(spark, sf_dir):
    slot = F.when(F.col("t") > 0.5, float("nan")).otherwise(F.col("t"))
    valid = scoring.valid_slot(slot)
    toxic = F.when(valid, scoring.is_toxic(F.col("l_returnflag") == "R", F.col("o"), 0.5))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", valid.alias("valid"), toxic.alias("toxic"), F.round(scoring.level_of_logprob(-F.col("c")), 6).alias("level"))


@query(ITEMS + "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-t)), 6) AS toxicity, round(1 / (1 + exp(-o)), 6) AS profanity, round(1 / (1 + exp(-c)), 6) AS threat FROM i")
def logit_scores(spark, sf_dir):
    s = scoring.scores_of_logits(F.array("t", "c", "o", "t", "o", "c", "t"))
    return items(spark, sf_dir).withColumn("s", s).select("l_orderkey", "l_linenumber", *[F.round(F.col(f"s.{n}"), 6).alias(n) for n in ("toxicity", "profanity", "threat")])


def language_clusters(spark, sf_dir):
    n = posts(spark, sf_dir).groupBy("account_id", "lang").agg(F.count("*").cast("double").alias("weight"))
    return n.select("account_id", F.col("lang").alias("cluster"), F.array("lang", F.concat("lang", F.lit("-word")), F.lit("shared")).alias("keywords"), "weight")


CLUSTERS = "WITH " + POSTS + ", k AS (SELECT account_id, lang, count(*)::DOUBLE AS weight FROM posts GROUP BY 1, 2) "


@query(CLUSTERS + "SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY weight DESC, lang) AS position, lang || '-word' AS keyword FROM k")
def search_keywords(spark, sf_dir):
    return topics.top_keywords(language_clusters(spark, sf_dir))


@query(CLUSTERS + "SELECT account_id, word, round(sum(weight / 3), 6) AS weight FROM (SELECT account_id, weight, unnest([lang, lang || '-word', 'shared']) AS word FROM k) GROUP BY 1, 2")
def keyword_weights(spark, sf_dir):
    return topics.keyword_weights(language_clusters(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("SELECT 'did:' || c_custkey AS did, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'Mutual follow' WHEN c_custkey % 3 = 0 THEN 'Follows you' WHEN c_custkey % 2 = 0 THEN 'You follow' ELSE 'Stranger' END AS graph_distance FROM customer")
def relationship_records(spark, sf_dir):
    c = F.col("c_custkey")
    one = F.struct(F.concat(F.lit("did:"), c).alias("did"), F.when(c % 2 == 0, "x").alias("following"), F.when(c % 3 == 0, "y").alias("followedBy"))
    raw = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.array(one).alias("relationships"))).alias("raw"))
    return records.relationships(raw, "raw")


@query("SELECT 'did:' || doc_id AS did, md5(text) AS said, 'at://' || doc_id AS uri FROM documents WHERE doc_id % 4 <> 0 AND text <> ''")
def thread_records(spark, sf_dir):
    d = F.col("doc_id")
    post = F.struct(F.concat(F.lit("at://"), d).alias("uri"), F.struct(F.when(d % 4 != 0, F.concat(F.lit("did:"), d)).alias("did")).alias("author"), F.struct("text").alias("record"))
    raw = table(spark, sf_dir, "documents").select(F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("post"))).alias("replies")).alias("thread"))).alias("raw"))
    return records.thread_replies(raw, "raw").select("did", F.md5(F.col("text").cast("binary")).alias("said"), "uri")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE 2 END AS n FROM orders")
def evidence_arrays(spark, sf_dir):
    raw = F.when(F.col("o_custkey") % 4 == 0, "not json").otherwise('["a", "b"]')
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(records.json_array(raw, "string")).alias("n"))


@query(EV + " SELECT amplifier, count(*) AS pairs FROM (SELECT DISTINCT amplifier, d.text FROM ev JOIN documents d ON ev.post = d.doc_id WHERE event_type IN ('quote', 'reply') AND d.text <> '') GROUP BY 1")
def direct_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("post"), F.xxhash64("text", F.md5(F.col("text").cast("binary"))).alias("said"))
    e = events(spark, sf_dir).where(F.col("event_type").isin("quote", "reply")).select("amplifier", "post").distinct()
    return e.join(d, "post").select("amplifier", "said").distinct().groupBy("amplifier").agg(F.count("*").alias("pairs"))


@query("WITH " + POSTS + " SELECT account_id, 'NotAssessed' AS tier, count(*) AS posts_analyzed FROM posts GROUP BY 1 HAVING count(*) FILTER (lang = 'en') < 5 AND count(*) FILTER (lang <> 'en') >= greatest(1, count(*) FILTER (lang = 'en'))")
def not_assessed_rows(spark, sf_dir):
    a = P.assess(posts(spark, sf_dir)).where("outcome = 'NotAssessed'").select("account_id")
    return posts(spark, sf_dir).join(a, "account_id", "left_semi").groupBy("account_id").agg(F.lit("NotAssessed").alias("tier"), F.count("*").alias("posts_analyzed"))


@query("SELECT o_orderkey, CASE WHEN o_custkey < 1024 THEN o_custkey || ' B' ELSE printf('%.1f KB', o_custkey / 1024.0) END AS size, CASE WHEN o_custkey % 3 = 0 THEN ' (tox: 0.50)' WHEN o_custkey % 3 = 1 THEN ' (tox: n/a)' ELSE '' END AS suffix, CASE WHEN o_custkey % 2 = 0 THEN '10.0.0.' || o_custkey ELSE 'unknown' END AS client, 'x' || o_custkey AS actor, 'y' AS token FROM orders")
def display_rows(spark, sf_dir):
    c = F.col("o_custkey")
    suffix = text.toxicity_suffix(F.when(c % 3 == 0, 0.5), c % 3 == 1)
    client = text.client_key(F.when(c % 2 == 0, F.concat(F.lit(" 10.0.0."), c, F.lit(", 1.1.1.1"))))
    shown = [suffix.alias("suffix"), client.alias("client"), text.actor(F.concat(F.lit("@x"), c)).alias("actor"), text.token_text(F.lit("▁y ")).alias("token")]
    return table(spark, sf_dir, "orders").select("o_orderkey", text.byte_size(c).alias("size"), *shown)


RATE = """WITH RECURSIVE """ + EVENTS + """, e AS (SELECT CAST(amplifier AS VARCHAR) AS key, event_id, ts, epoch(ts) AS t, row_number() OVER (PARTITION BY amplifier ORDER BY ts, event_id) AS n FROM ev),
r AS (SELECT key, n, ts, t AS start, 1 AS used FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, e.ts, CASE WHEN e.t >= r.start + 86400 THEN e.t ELSE r.start END, CASE WHEN e.t >= r.start + 86400 THEN 1 ELSE r.used + 1 END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, CAST(round(epoch(ts)) AS BIGINT) AS at, count(*) FILTER (used <= 5) AS allowed, count(*) AS asked FROM r GROUP BY 1, 2"""


@query(RATE)
def rate_limited(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("amplifier").cast("string").alias("key"), "ts")
    made = limits.limited_batch(e, 5, 86400)
    return made.groupBy("key", F.round(F.col("ts").cast("double")).cast("long").alias("at")).agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("asked"))
