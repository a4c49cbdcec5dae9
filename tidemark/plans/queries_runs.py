"""Queries over runs that commit as they go, streams with state, and failures by kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hints, text
from ..operators import classify, verdicts
from ..operators import posts as P
from ..sources import paged, queue, records
from ..sources.scratch import shared_dir
from ..sources.store import Store, with_ids
from ..streaming import limits, pile_on
from . import amplification, phases
from .base import EVENTS, FOLLOWS, POSTS, events, follows, posts, table
from .registry import query
from .queries_composed import COS, DAY0, PHASED, SCORED, VECTORS, _hostility, originals, scored
from .queries_discovery import RATE
from .queries_events import EV, PILED


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives over what is there."""
    with pile_on.keyed_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(EV + " " + PILED.format("ev"))
def pile_on_online(spark, sf_dir):
    """Events arrive in four micro-batches without any order; who takes part is told as soon as it is known."""
    e, folder = events(spark, sf_dir).select("post", "amplifier", "ts"), new_folder(spark, "piled")
    e.repartition(4, F.xxhash64("ts", "amplifier")).write.parquet(f"{folder}/in")
    span = e.agg(F.ceil((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400)).first()[0] or 0
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return drained(pile_on.online(stream, f"{span + 1} days"), folder).select("amplifier").distinct()


@query(RATE)
def rate_limited_online(spark, sf_dir):
    """The limiter over a stream of three files, one micro-batch each; as many keys as there are fit in."""
    e, folder = events(spark, sf_dir).select(F.col("amplifier").cast("string").alias("key"), "ts"), new_folder(spark, "limited")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    for lo, hi in ((first, first + third), (first + third, first + 2 * third), (first + 2 * third, None)):
        part = e.where((F.col("ts") >= lo) & (F.col("ts") < hi if hi else F.lit(True)))
        part.repartitionByRange(1, "ts").sortWithinPartitions("ts").write.mode("append").parquet(f"{folder}/in")
    made = drained(limits.limited(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), 5, 86400, most_keys=1 << 20), folder)
    return made.groupBy("key", F.round(F.col("ts").cast("double")).cast("long").alias("at")).agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("asked"))


CHUNK = 16


def _ask(texts: list[str]) -> list:
    """A classifier that fails by what it is asked."""
    said = sum(map(len, texts)) % 11
    if said == 0:
        raise classify.Transient("busy")
    if said == 1:
        raise classify.CostCapped("no more")
    if said == 2:
        return [(False, 0.5)] * (len(texts) - 1)
    return [ValueError("not read") if len(t) % 7 == 0 else (len(t) % 2 == 0, len(t) % 100 / 100) for t in texts]


CHUNKED = (
    "WITH " + POSTS + """, n AS (SELECT *, row_number() OVER (ORDER BY account_id, uri) - 1 AS _n FROM posts WHERE score >= 0.1),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY _n // 16) % 11 AS said FROM n),
t AS (SELECT account_id, uri, CASE said WHEN 0 THEN 'transient' WHEN 1 THEN 'cost_cap' WHEN 2 THEN 'abort' END AS failure, CASE WHEN said = 0 THEN 3 ELSE 1 END AS tries,
  CASE WHEN said > 2 THEN length(text) % 7 <> 0 AND length(text) % 2 = 0 END AS toxic_token,
  CASE WHEN said > 2 THEN CASE WHEN length(text) % 7 = 0 THEN 0.0 ELSE length(text) % 100 / 100.0::DOUBLE END END AS confidence,
  CASE WHEN said > 2 THEN CASE WHEN length(text) % 7 = 0 THEN 'decode-error' ELSE 'model' END END AS model_id FROM c) """
)


def in_chunks(rows: DataFrame) -> DataFrame:
    return classify.in_chunks(rows.withColumn("chunk", F.floor(F.col("_n") / CHUNK)), _ask)


@query(CHUNKED + "SELECT uri, failure, tries, toxic_token, confidence, model_id FROM t")
def classified_in_chunks(spark, sf_dir):
    p = with_ids(posts(spark, sf_dir).where("score >= 0.1"), ["account_id", "uri"], "_n", -1, shared_dir(spark) + "/ids")
    return in_chunks(p).select("uri", "failure", "tries", "toxic_token", "confidence", "model_id")


@query(CHUNKED + "SELECT account_id, count(*) AS queued, count(toxic_token) AS judged, count(*) FILTER (toxic_token) AS toxic, count(failure) AS failed FROM t GROUP BY 1")
def queue_after_failures(spark, sf_dir):
    """One try of the queue: verdicts appended as deltas, failures kept with their rows, which stay pending."""
    s = Store(spark, new_folder(spark, "store"))
    queue.push(s, "queue", posts(spark, sf_dir).where("score >= 0.1").select("account_id", "uri", "text", "score", F.lit("pending").alias("status")))
    waiting = with_ids(queue.current(s, "queue").where("status = 'pending'").select("account_id", "uri", "text"), queue.KEYS, "_n", -1, f"{s.root}/_staged")
    queue.judge(s, "queue", in_chunks(waiting))
    done = F.col("status") == "done"
    return queue.current(s, "queue").groupBy("account_id").agg(F.count("*").alias("queued"), F.count_if(done).alias("judged"), F.count_if(done & F.col("toxic_token")).alias("toxic"), F.count("failure").alias("failed"))


@query(PHASED + "SELECT account_id, round(score, 5) AS score, tier FROM scores")
def phased_scan_drained(spark, sf_dir):
    """The run as it is: gathered, stopped, resumed under a lease, drained in batches, finalized."""
    p = posts(spark, sf_dir)
    judge = lambda rows: rows.withColumn("toxic_token", F.col("uri") % 2 == 0).withColumn("confidence", F.col("score"))
    overlap = p.groupBy("account_id").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("overlap"))
    s, rest = Store(spark, new_folder(spark, "store")), (p, p.select("uri", "text"), overlap, p.select("account_id").where("false"), judge)
    phases.run(s, *rest, stop_after="gather")
    return phases.run(s, *rest, batch=600, owner="query").select("account_id", F.round("score", 5).alias("score"), "tier")


PEOPLE = 200

AMPLIFIED = (
    "WITH " + EVENTS + ", " + FOLLOWS + ", " + SCORED + ", " + VECTORS + ", "
    + POSTS.replace("d.source AS account_id", "d.doc_id % 200 AS account_id").replace("posts AS (", "every AS (", 1)
    + """, k AS (SELECT ev.*, r.text, row_number() OVER (PARTITION BY CASE WHEN event_type = 'like' THEN amplifier || '|' || post ELSE CAST(event_id AS VARCHAR) END ORDER BY ts, CAST(event_id AS VARCHAR)) AS nth FROM ev LEFT JOIN documents r ON event_id = r.doc_id),
rec AS (SELECT * FROM k WHERE nth = 1),
dp AS (SELECT DISTINCT e.amplifier AS account_id, o.text AS original, e.text AS response FROM rec e JOIN documents o ON e.post = o.doc_id WHERE e.event_type IN ('quote', 'reply') AND e.text <> '' AND o.text <> ''),
a AS (SELECT DISTINCT amplifier AS account_id FROM rec), fol AS (SELECT DISTINCT src AS account_id FROM follows WHERE dst = 1),
piled AS (""" + PILED.format("rec") + """),
cand AS (SELECT account_id, account_id IN (SELECT amplifier FROM piled) AS pile_on,
  CASE WHEN account_id IN (SELECT dst FROM follows WHERE src = 1) AND account_id IN (SELECT account_id FROM fol) THEN 0.6 WHEN account_id IN (SELECT account_id FROM fol) THEN 0.8 WHEN account_id IN (SELECT dst FROM follows WHERE src = 1) THEN 0.9 ELSE 1.2 END AS weight
  FROM (SELECT account_id FROM a UNION SELECT account_id FROM fol) WHERE account_id <> 1 AND account_id NOT IN (SELECT account_id FROM sc WHERE scored_at >= TIMESTAMP '2024-01-08')),
g AS (SELECT account_id, pile_on, weight, count(*) AS n, count(*) FILTER (post_kind = 'reply') AS nr, count(*) FILTER (post_kind = 'quote') AS nq,
  count(*) FILTER (post_kind = 'reply' AND is_toxic) AS tr, count(*) FILTER (post_kind <> 'reply' AND is_toxic) AS tot, avg(likes + reposts) AS eng, count(*) FILTER (lang = 'en') / count(*)::DOUBLE AS overlap
  FROM every JOIN cand USING (account_id) GROUP BY ALL),
h AS (SELECT *, nq / n::DOUBLE AS q, nr / n::DOUBLE AS r, CASE WHEN nr < 5 THEN (tr + tot) / n::DOUBLE ELSE 0.7 * tr / nr + 0.3 * (CASE WHEN n > nr THEN tot / (n - nr)::DOUBLE ELSE 0 END) END AS tox, median(eng) OVER () AS med FROM g),
b AS (SELECT *, CASE WHEN overlap < 0.15 THEN least(tox * 25, 25) ELSE least(tox * 70 * (1 + overlap * 1.5), 100) END AS base, 1 + 0.20 * q + 0.15 * r + CASE WHEN pile_on THEN 0.15 ELSE 0 END AS boost, q < 0.15 AND r < 0.30 AND NOT pile_on AND eng > med AS benign FROM h),
s1 AS (SELECT *, least((CASE WHEN benign THEN least(base, 12) ELSE least(base * boost, 100) END) * weight, 100) AS first_score FROM b),
mine AS (SELECT v.vec_id AS mine_id, a AS b, text FROM v JOIN documents ON vec_id = doc_id WHERE doc_id % 200 = 1),
mean AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(b[i]) AS x FROM mine, range(1, 65) r(i) GROUP BY i)),
tg AS (SELECT d.doc_id % 200 AS account_id, v.vec_id AS target_id, a, d.text FROM v JOIN documents d ON vec_id = doc_id WHERE d.doc_id % 200 IN (SELECT account_id FROM s1 WHERE first_score >= 8) AND d.doc_id % 200 NOT IN (SELECT account_id FROM dp)),
sim AS (SELECT tg.*, """ + COS.format("tg.a", "mean.m") + """ AS similarity FROM tg, mean),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY similarity DESC, target_id) AS n FROM sim) WHERE n <= 3),
near AS (SELECT target_id, mine_id FROM (SELECT target_id, mine_id, row_number() OVER (PARTITION BY target_id ORDER BY round(""" + COS.format("top.a", "mine.b") + """, 12) DESC, mine_id DESC) AS n FROM top, mine) WHERE n = 1),
pr AS (SELECT * FROM dp UNION ALL SELECT top.account_id, m.text, top.text FROM top JOIN near USING (target_id) JOIN mine m USING (mine_id) WHERE m.text <> ''),
cx AS (SELECT account_id, avg((z % 10) / 10.0) AS context FROM (SELECT account_id, length(original) * 3 + length(response) AS z FROM pr) WHERE z % 11 <> 0 GROUP BY 1),
e AS (SELECT s1.*, context, benign AND coalesce(context, 0) >= 0.5 AS strong FROM s1 LEFT JOIN cx USING (account_id)),
f AS (SELECT *, least((CASE WHEN strong OR NOT benign THEN least(base * boost, 100) ELSE least(base, 12) END) * (CASE WHEN strong OR context IS NULL THEN 1 ELSE 1 + 0.5 * context END) * weight, 100) AS score FROM e)
SELECT account_id, pile_on, weight AS distance_weight, round(context, 6) AS context, round(first_score, 5) AS first_score, round(score, 5) AS score,
  CASE WHEN score >= 35 THEN 'High' WHEN score >= 15 THEN 'Elevated' WHEN score >= 8 THEN 'Watch' ELSE 'Low' END AS tier FROM f"""
)


@query(AMPLIFIED)
def amplification_scored(spark, sf_dir):
    """Events to scores in one restartable run, killed once on its way: pile-on, distance, direct and inferred context together."""
    p = posts(spark, sf_dir).withColumn("account_id", F.col("uri") % PEOPLE)
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    e = events(spark, sf_dir).join(said, "event_id", "left").withColumn("uri", F.col("event_id").cast("string")).drop("event_id")
    v = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").withColumn("account_id", F.col("vec_id") % PEOPLE)
    mine = v.where("account_id = 1").select(F.col("vec_id").alias("mine_id"), "text", F.col("embedding").alias("b"))
    targets = v.where("account_id <> 1").select("account_id", F.col("vec_id").alias("target_id"), "text", F.col("embedding").alias("a"))
    overlap = p.groupBy("account_id").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("overlap"))
    s = Store(spark, new_folder(spark, "store"))
    run = lambda stop=None: amplification.scored(s, "query", e, originals(spark, sf_dir), follows(spark, sf_dir), 1, p, overlap, targets, mine, _hostility, scored(spark, sf_dir), DAY0, stop_after=stop)
    run("first")
    last, first = run(), s.read("first_scores").select("account_id", F.col("score").alias("first_score"))
    weight = F.create_map(*[F.lit(x) for kv in {"Mutual follow": 0.6, "Follows you": 0.8, "You follow": 0.9, "Stranger": 1.2}.items() for x in kv])[F.col("graph_distance")]
    return last.join(first, "account_id").select("account_id", "pile_on", weight.alias("distance_weight"), F.round("context", 6).alias("context"), F.round("first_score", 5).alias("first_score"), F.round("score", 5).alias("score"), "tier")


@query("SELECT round(median(value), 6) AS median FROM events")
def median_in_passes(spark, sf_dir):
    """The exact median of a column, narrowed by sketches until a few values are left."""
    return P.median_of(table(spark, sf_dir, "events"), "value", few=64).select(F.round("median", 6).alias("median"))


def pages_of(spark: SparkSession, sf_dir: str, size: int = 20) -> str:
    """Posts of each account as feed pages of ``size``, oldest page 0, newest item of a page first; the folder."""
    p = posts(spark, sf_dir).select(F.col("account_id").alias("author"), "seq", F.col("uri").cast("string").alias("uri"), "text")
    # Numbered by ranges: an author may have more posts than one task should sort.
    p = with_ids(p, ["author", "seq"], "_n", -1, shared_dir(spark) + "/ids")
    first = p.groupBy(F.col("author").alias("_author")).agg(F.min("_n").alias("_first"))
    p = p.join(F.broadcast(first), F.col("author").eqNullSafe(F.col("_author"))).withColumn("page", F.floor((F.col("_n") - F.col("_first")) / size))
    items = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("seq", "uri", "text")))), lambda x: x)
    made = p.groupBy("author", "page").agg(items.alias("items")).withColumn("cursor", F.when(F.col("page") > 0, F.col("page") - 1))
    line = F.to_json(F.struct("cursor", "items"), {"ignoreNullFields": "false"})
    folder = new_folder(spark, "feed")
    # Tasks commit their own pages; else the driver would move all of them, one after the other.
    writer = made.select("author", F.lpad(F.col("page").cast("string"), 8, "0").alias("page"), line.alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("author", "page").text(folder)
    return folder


@query("WITH " + POSTS + ", n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) AS nth FROM posts) SELECT account_id, uri::VARCHAR AS uri, md5(text) AS text FROM n WHERE nth <= 30")
def feed_newest(spark, sf_dir):
    """The 30 newest posts of each account, from pages of 20: two pages of each are read, whatever the account has."""
    return paged.feed(spark, pages_of(spark, sf_dir), most=30).select(F.col("author").alias("account_id"), "uri", F.md5(F.col("text").cast("binary")).alias("text"))


@query("WITH " + POSTS + " SELECT uri::VARCHAR AS uri, seq FROM posts WHERE account_id = 'src3' AND seq > (SELECT quantile_disc(seq, 0.8) FROM posts)")
def feed_since(spark, sf_dir):
    """One account's posts after a point: other folders and older pages aren't read."""
    since = posts(spark, sf_dir).agg(F.expr("percentile_disc(0.8) WITHIN GROUP (ORDER BY seq)")).first()[0]
    return paged.feed(spark, pages_of(spark, sf_dir)).where((F.col("author") == "src3") & (F.col("seq") > since)).select("uri", "seq")


RAW = "r AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN props[1:len(props) - 1] WHEN event_id % 5 = 0 THEN replace(replace(props, ': ', ': \"x'), '}', '\"}') ELSE props END AS raw FROM events)"


@query("WITH " + RAW + " SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS malformed, count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 = 0) AS of_another_type, CAST(sum(CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN CAST(raw->>'$.k' AS BIGINT) END) AS BIGINT) AS k FROM r GROUP BY 1")
def typed_properties(spark, sf_dir):
    """Properties decoded by type, some of them cut off and some of another type: what is malformed is counted, not lost."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    raw = F.when(i % 7 == 0, F.expr("left(props, length(props) - 1)")).when(i % 5 == 0, F.replace(F.replace("props", F.lit(": "), F.lit(': "x')), F.lit("}"), F.lit('"}'))).otherwise(F.col("props"))
    made = records.typed(e.select("event_id", "event_type", raw.alias("raw")), "raw", {"k": ("$.k", "long"), "other": ("$.other", "string")})
    return made.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed") & F.col("k").isNull() & F.col("other").isNull()).alias("of_another_type"), F.sum("k").alias("k")
    )


@query("WITH " + POSTS + ", t AS (SELECT uri AS root FROM posts WHERE post_kind = 'original') SELECT p.parent_uri AS root, p.uri, md5(p.text) AS text FROM posts p JOIN t ON p.parent_uri = t.root")
def thread_by_parent(spark, sf_dir):
    p = posts(spark, sf_dir)
    found = records.replies_to(p, p.where("post_kind = 'original'"))
    return found.select("root", "uri", F.md5(F.col("text").cast("binary")).alias("text"))


@query("WITH " + POSTS.replace("d.source AS account_id", "d.source || '-' || d.lang AS account_id") + """, g AS (SELECT account_id, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang <> 'en') AS u FROM posts GROUP BY 1),
x AS (SELECT account_id, count(score) >= 5 AND max(score) < 0.5 AS calm FROM posts WHERE post_kind <> 'reply' GROUP BY 1)
SELECT account_id, a AS assessable, CASE WHEN a < 5 AND u >= greatest(1, a) THEN 'NotAssessed' WHEN a < 5 THEN 'InsufficientData' WHEN calm THEN 'Low' ELSE 'Proceed' END AS stage1 FROM g LEFT JOIN x USING (account_id)""")
def stage1_outcomes(spark, sf_dir):
    """Scores are scaled down to a fifth here, so that some accounts are calm."""
    p = posts(spark, sf_dir).withColumn("account_id", F.concat_ws("-", "account_id", "lang"))
    return P.stage1(p, p.where("post_kind <> 'reply'").withColumn("score", F.col("score") / 5), F.lit(0.0))


@query("SELECT l_suppkey AS account_id, uri, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS uri, CAST(l_discount AS DOUBLE) AS similarity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem) WHERE rank <= 10")
def pairs_by_similarity(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("account_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uri"), F.col("l_discount").cast("double").alias("similarity"))
    return P.top_pairs(pairs, 10).withColumn("similarity", F.round("similarity", 6))


@query("WITH " + POSTS + ", n AS (SELECT account_id, count(*) AS n, count(*) FILTER (text IS NULL OR text = '') AS bad, sum(length(text)) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) AS nth FROM posts) WHERE nth <= 50 GROUP BY 1) SELECT account_id, CASE WHEN chars % 3 <> 0 THEN chars END AS chars, CASE WHEN chars % 3 = 0 THEN 'ValueError: not today' END AS error FROM n")
def accounts_isolated(spark, sf_dir):
    """A step in Python over each account's newest posts that fails for some accounts: those have an error, the others their result."""

    def work(frame):
        n = int(frame.text.str.len().sum())
        if n % 3 == 0:
            raise ValueError("not today")
        return frame.head(1).assign(chars=n)[["chars"]]

    return verdicts.each_account(P.newest(posts(spark, sf_dir), 50).select("account_id", "text"), work, "chars long")


TEMPLATE = "POLICY\n<<policy>>\nCONTENT\n<<content>>\nEND"


@query("SELECT doc_id, md5('POLICY' || chr(10) || source || ' says <<content>>' || chr(10) || 'CONTENT' || chr(10) || text || chr(10) || 'END') AS prompt FROM documents")
def prompts(spark, sf_dir):
    """A mark that stands in a value stays as it is."""
    values = {"<<policy>>": F.concat("source", F.lit(" says <<content>>")), "<<content>>": F.col("text")}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.filled(TEMPLATE, values).cast("binary")).alias("prompt"))


#: Kinds of a text by words that the tables have; two of them can be in one text.
WORDS = {"past": [" was ", " were "], "present": [" is ", " are "], "other": ["the", "data"]}


@query("SELECT doc_id, CASE WHEN contains(lower(text), ' was ') OR contains(lower(text), ' were ') THEN 'past' WHEN contains(lower(text), ' is ') OR contains(lower(text), ' are ') THEN 'present' WHEN contains(lower(text), 'the') OR contains(lower(text), 'data') THEN 'other' END AS kind, CASE WHEN regexp_matches(lower(text), 'ratio|we all|everyone agrees|consensus') THEN 'dogpile' WHEN regexp_matches(lower(text), 'love you|proud of|you matter|we got you|with you|rooting for') THEN 'support' END AS category FROM documents")
def category_hints(spark, sf_dir):
    """Documents by the first hint that they hold: of words of the tables, and of two of the built-in categories."""
    built_in = {c: hints.CATEGORIES[c] for c in ("dogpile", "support")}
    return table(spark, sf_dir, "documents").select("doc_id", text.first_match(F.col("text"), WORDS).alias("kind"), text.first_match(F.col("text"), built_in).alias("category"))
