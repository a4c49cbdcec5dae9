"""Queries over posts, topics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, vectors
from ..functions.stopwords import stop_words
from ..functions.text import meaningful
from ..operators import nearest, topics, verdicts
from ..operators import posts as P
from . import ranking
from .base import POSTS, posts, table
from .registry import query

AFTER_POSTS = """, g AS (
  SELECT account_id, count(*) AS n,
    count(*) FILTER (post_kind = 'original') AS no0, count(*) FILTER (post_kind = 'reply') AS nr, count(*) FILTER (post_kind = 'quote') AS nq,
    count(*) FILTER (post_kind = 'reply' AND is_toxic) AS tr, count(*) FILTER (post_kind <> 'reply' AND is_toxic) AS tot,
    avg(likes + reposts) AS eng, count(*) FILTER (lang = 'en') / count(*)::DOUBLE AS overlap
  FROM posts GROUP BY account_id
), h AS (
  SELECT *, nq / n::DOUBLE AS q, nr / n::DOUBLE AS r,
    CASE WHEN nr < 5 THEN (tr + tot) / n::DOUBLE ELSE 0.7 * tr / nr + 0.3 * (CASE WHEN n > nr THEN tot / (n - nr)::DOUBLE ELSE 0 END) END AS tox,
    median(eng) OVER () AS med FROM g
), b AS (
  SELECT *, CASE WHEN overlap < 0.15 THEN least(tox * 25, 25) ELSE least(tox * 70 * (1 + overlap * 1.5), 100) END AS base,
    1 + 0.20 * q + 0.15 * r AS boost, q < 0.15 AND r < 0.30 AND eng > med AS benign FROM h
), s AS (
  SELECT *, CASE WHEN benign THEN least(base, 12) ELSE least(base * boost, 100) END AS score FROM b
), scores AS (
  SELECT *, CASE WHEN score >= 35 THEN 'High' WHEN score >= 15 THEN 'Elevated' WHEN score >= 8 THEN 'Watch' ELSE 'Low' END AS tier FROM s
) """
SCORES = "WITH " + POSTS + AFTER_POSTS


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    overlap = p.groupBy("account_id").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("overlap"))
    nobody = p.select("account_id").where("false")
    return ranking.account_scores(p, overlap, nobody)


@query(SCORES + "SELECT account_id, n AS posts_analyzed, round(tox, 6) AS toxicity, round(overlap, 6) AS overlap, round(score, 5) AS threat_score, tier FROM scores")
def threat_ranking(spark, sf_dir):
    s = scores(spark, sf_dir).orderBy(F.desc("score"), "account_id")
    return s.select("account_id", F.col("n_posts").alias("posts_analyzed"), F.round("toxicity", 6).alias("toxicity"), F.round("overlap", 6).alias("overlap"), F.round("score", 5).alias("threat_score"), "tier")


SIGNALS = (
    "WITH " + POSTS + AFTER_POSTS[: AFTER_POSTS.index(", b AS (")]
    + """, x AS (SELECT *, CAST(substr(account_id, 4) AS INTEGER) AS num FROM h), y AS (
  SELECT *, num % 3 = 0 AS pile, CASE num % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.2 WHEN 2 THEN 0.6 END AS ctx,
    CASE num % 5 WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 1.2 ELSE 1.0 END AS dist,
    CASE WHEN overlap < 0.15 THEN least(tox * 25, 25) ELSE least(tox * 70 * (1 + overlap * 1.5), 100) END AS base FROM x
), z AS (
  SELECT *, 1 + 0.20 * q + 0.15 * r + CASE WHEN pile THEN 0.15 ELSE 0 END AS boost, q < 0.15 AND r < 0.30 AND NOT pile AND eng > med AS benign FROM y
), v AS (
  SELECT *, CASE WHEN benign AND coalesce(ctx, 0) < 0.5 THEN least(base, 12) ELSE least(base * boost, 100) END AS behav,
    CASE WHEN benign AND ctx >= 0.5 THEN NULL ELSE ctx END AS ctx_left FROM z
) SELECT account_id, benign, round(least(behav * (1 + 0.5 * coalesce(ctx_left, 0)) * dist, 100), 5) AS score FROM v"""
)


@query(SIGNALS)
def threat_with_signals(spark, sf_dir):
    """Pile-on, context and distance all at work."""
    p = posts(spark, sf_dir)
    overlap = p.groupBy("account_id").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("overlap"))
    n = F.substring("account_id", 4, 10).cast("int")
    every = p.select("account_id").distinct()
    names = F.create_map(*[F.lit(x) for kv in enumerate(["Mutual follow", "Follows you", "You follow", "Stranger"]) for x in kv])
    context = every.select("account_id", F.when(n % 4 == 0, 0.9).when(n % 4 == 1, 0.2).when(n % 4 == 2, 0.6).alias("context"))
    s = ranking.account_scores(p, overlap, every.where(n % 3 == 0), context, every.select("account_id", names[n % 5].alias("graph_distance")))
    return s.select("account_id", "benign", F.round("score", 5).alias("score"))


@query(SCORES + "SELECT count(*) FILTER (tier = 'High') AS high, count(*) FILTER (tier = 'Elevated') AS elevated, count(*) FILTER (tier = 'Watch') AS watch, count(*) FILTER (tier = 'Low') AS low, CAST(0 AS BIGINT) AS not_assessed, CAST(0 AS BIGINT) AS insufficient, count(*) AS total FROM scores")
def tier_histogram(spark, sf_dir):
    return verdicts.histogram(scores(spark, sf_dir))


@query(SCORES + "SELECT rank, account_id, round(score, 5) AS score FROM (SELECT row_number() OVER (ORDER BY score DESC, account_id) AS rank, * FROM scores) WHERE rank > 5 AND rank <= 10")
def paged_accounts(spark, sf_dir):
    return ranking.page(scores(spark, sf_dir), 2, 5).select("rank", "account_id", F.round("score", 5).alias("score"))


@query(SCORES + "SELECT account_id, round(tox, 6) AS toxicity, tr AS toxic_replies, nr AS replies FROM scores")
def reply_weighted_toxicity(spark, sf_dir):
    return P.toxicity(posts(spark, sf_dir)).select("account_id", F.round("toxicity", 6).alias("toxicity"), F.col("tr").alias("toxic_replies"), F.col("nr").alias("replies"))


@query(SCORES + "SELECT account_id, round(q, 6) AS quote_ratio, round(r, 6) AS reply_ratio, round(eng, 6) AS avg_engagement, round(boost, 6) AS boost, benign FROM scores")
def behavioral_signals(spark, sf_dir):
    return scores(spark, sf_dir).select("account_id", *[F.round(c, 6).alias(c) for c in ("quote_ratio", "reply_ratio", "avg_engagement", "boost")], "benign")


@query(SCORES + "SELECT round(max(med), 6) AS median FROM scores")
def median_engagement(spark, sf_dir):
    return P.median_of(P.engagement(posts(spark, sf_dir)), "avg_engagement").select(F.round("median", 6).alias("median"))


@query(SCORES + "SELECT account_id, CASE WHEN no0 >= 15 THEN 'normal' WHEN no0 = 0 THEN 'unreliable' WHEN n >= 15 THEN 'degraded' ELSE 'unreliable' END AS quality, CASE WHEN no0 >= 15 THEN 'high' ELSE 'standard' END AS confidence FROM scores")
def fingerprint_quality(spark, sf_dir):
    s = scores(spark, sf_dir)
    return s.select("account_id", "quality", scoring.confidence(F.col("quality"), F.lit(False)).alias("confidence"))


@query("WITH " + POSTS + """, a AS (SELECT account_id, bool_or(is_toxic) AS any_toxic FROM posts GROUP BY account_id), k AS (
  SELECT p.account_id, p.uri, p.score, row_number() OVER (PARTITION BY p.account_id ORDER BY p.score DESC, CASE post_kind WHEN 'original' THEN 0 WHEN 'reply' THEN 1 ELSE 2 END, seq) AS rank
  FROM posts p JOIN a ON p.account_id = a.account_id WHERE p.is_toxic OR NOT a.any_toxic)
SELECT account_id, uri, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def evidence_top3(spark, sf_dir):
    return P.evidence(posts(spark, sf_dir)).select("account_id", "uri", "score", "rank")


@query("WITH " + POSTS + " SELECT account_id, count(*) FILTER (lang = 'en') AS assessable, count(*) FILTER (lang <> 'en') AS unassessable, CASE WHEN count(*) FILTER (lang = 'en') >= 5 THEN 'Score' WHEN count(*) FILTER (lang <> 'en') >= 1 AND count(*) FILTER (lang <> 'en') >= count(*) FILTER (lang = 'en') THEN 'NotAssessed' ELSE 'InsufficientData' END AS outcome FROM posts GROUP BY account_id")
def coverage_gate(spark, sf_dir):
    return P.assess(posts(spark, sf_dir)).select("account_id", "assessable", "unassessable", "outcome")


@query("WITH " + POSTS + " SELECT uri, lang = 'en' AS assessable FROM posts")
def lang_gate(spark, sf_dir):
    from ..functions import language

    return posts(spark, sf_dir).select("uri", language.assessable(F.col("text"), F.col("langs")).alias("assessable"))


@query("WITH " + POSTS + " SELECT account_id, uri FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) AS n FROM posts WHERE length(text) >= 15) WHERE n <= 25")
def author_feed_sample(spark, sf_dir):
    return P.newest(P.scan(posts(spark, sf_dir)), 25).select("account_id", "uri")


@query("WITH " + POSTS + " SELECT account_id, count(*) AS n_posts, count(*) FILTER (post_kind = 'original') AS n_original, count(*) FILTER (post_kind = 'reply') AS n_reply, count(*) FILTER (post_kind = 'quote') AS n_quote FROM posts GROUP BY account_id")
def sample_by_kind(spark, sf_dir):
    return P.ratios(posts(spark, sf_dir)).select("account_id", "n_posts", "n_original", "n_reply", "n_quote")


@query("WITH " + POSTS + " SELECT r.uri, md5(CASE WHEN p.text IS NULL THEN r.text ELSE '[Parent post]: ' || p.text || chr(10) || chr(10) || '[Reply]: ' || r.text END) AS envelope FROM posts r LEFT JOIN posts p ON r.parent_uri = p.uri")
def parent_envelope(spark, sf_dir):
    from ..functions.text import envelope

    p = posts(spark, sf_dir)
    joined = P.with_parents(p, p.select("uri", "text"))
    return joined.select("uri", F.md5(envelope(F.col("parent_text"), F.col("text")).cast("binary")).alias("envelope"))


@query("WITH " + POSTS + ", n AS (SELECT account_id, count(*) FILTER (post_kind = 'original') AS o FROM posts GROUP BY account_id) SELECT p.account_id, count(*) AS posts FROM posts p JOIN n ON p.account_id = n.account_id WHERE n.o < 15 OR p.post_kind = 'original' GROUP BY p.account_id")
def fingerprint_selection(spark, sf_dir):
    return P.fingerprint_posts(posts(spark, sf_dir)).groupBy("account_id").agg(F.count("*").alias("posts"))


@query("WITH " + POSTS + " SELECT account_id, count(score) AS n, max(score) AS top, count(score) >= 5 AND max(score) < 0.1 AS early_exit FROM posts WHERE post_kind <> 'reply' GROUP BY account_id")
def stage1_early_exit(spark, sf_dir):
    p = posts(spark, sf_dir).where("post_kind <> 'reply'")
    return P.early_exit(p, F.lit(0.0)).select("account_id", "n", "top", "early_exit")


@query("WITH " + POSTS + " SELECT CASE WHEN score < 0.1 THEN 'OnnxCleared' WHEN uri % 2 = 0 AND score >= 0.5 THEN 'ClassifierToxic' ELSE 'ClassifierSafe' END AS source, count(*) AS n FROM posts GROUP BY 1")
def two_stage_verdicts(spark, sf_dir):
    classify = lambda df: df.withColumn("toxic_token", F.col("uri") % 2 == 0).withColumn("confidence", F.col("score"))
    return verdicts.two_stage(posts(spark, sf_dir), classify).groupBy("source").agg(F.count("*").alias("n"))


@query("WITH " + POSTS + " SELECT account_id, bool_and(uri % 17 <> 0) AS complete, count(*) AS queued, count(*) FILTER (uri % 17 <> 0) AS judged FROM posts GROUP BY account_id")
def verdict_completeness(spark, sf_dir):
    q = posts(spark, sf_dir).select("account_id", F.when(F.col("uri") % 17 == 0, "pending").otherwise("done").alias("status"), F.lit(True).alias("toxic_token"))
    return verdicts.complete(q)


@query("WITH l AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b FROM labels) SELECT count(*) AS total, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_ok, count(*) FILTER (a IS NULL) AS a_errors, count(*) FILTER (b IS NULL) AS b_errors, count(*) FILTER (a AND b) AS both_toxic, count(*) FILTER (NOT a AND NOT b) AS both_safe, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, round(avg((a = b)::INT), 6) AS agreement FROM l")
def verdict_comparison(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return verdicts.compare(pairs).withColumn("agreement", F.round("agreement", 6))


@query("WITH l AS (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels) SELECT count(*) AS both_ok, round(avg((a = b)::INT), 6) AS agreement, count(*) >= 50 AND avg((a = b)::INT) >= 0.85 AS passed FROM l")
def agreement_gate(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return verdicts.gate(pairs).withColumn("agreement", F.round("agreement", 6))


@query("SELECT doc_id FROM labels WHERE (quality = 1) <> (toxic = 0)")
def verdict_disagreements(spark, sf_dir):
    return table(spark, sf_dir, "labels").where((F.col("quality") == 1) != (F.col("toxic") == 0)).select("doc_id")


LABELLED = ", lab AS (SELECT account_id, CASE CAST(substr(account_id, 4) AS INTEGER) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'elevated' WHEN 2 THEN 'watch' ELSE 'safe' END AS label FROM scores WHERE CAST(substr(account_id, 4) AS INTEGER) % 5 <> 0) "


def labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = scores(spark, sf_dir).select("account_id", "tier", "score")
    n = F.substring("account_id", 4, 10).cast("int")
    names = F.array(*[F.lit(x) for x in ("high", "elevated", "watch", "safe")])
    return s, s.where(n % 5 != 0).select("account_id", F.element_at(names, n % 4 + 1).alias("label"))


@query(SCORES + LABELLED + ", r AS (SELECT CASE lower(tier) WHEN 'high' THEN 3 WHEN 'elevated' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS g, CASE label WHEN 'high' THEN 3 WHEN 'elevated' THEN 2 WHEN 'watch' THEN 1 ELSE 0 END AS w FROM scores JOIN lab USING (account_id)) SELECT count(*) AS total, count(*) FILTER (g = w) AS exact, count(*) FILTER (g > w) AS over, count(*) FILTER (g < w) AS under, round(avg((g = w)::INT), 6) AS accuracy FROM r")
def label_accuracy(spark, sf_dir):
    s, l = labelled(spark, sf_dir)  # noqa: E741
    return verdicts.accuracy(l, s, ["account_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query(SCORES + LABELLED + "SELECT account_id, round(score, 5) AS score FROM scores WHERE account_id NOT IN (SELECT account_id FROM lab) ORDER BY scores.score DESC, account_id LIMIT 20")
def unlabeled_queue(spark, sf_dir):
    s, l = labelled(spark, sf_dir)  # noqa: E741
    return s.join(l, "account_id", "left_anti").orderBy(F.desc("score"), "account_id").limit(20).select("account_id", F.round("score", 5).alias("score"))


@query(SCORES + LABELLED + "SELECT s.account_id, s.tier, lab.label FROM scores s LEFT JOIN lab USING (account_id)")
def account_detail(spark, sf_dir):
    s, l = labelled(spark, sf_dir)  # noqa: E741
    return s.join(l, "account_id", "left").select("account_id", "tier", "label")


@query(SCORES + "SELECT round(avg((tier <> 'Low')::INT), 6) AS detection_rate FROM scores")
def detection_rate(spark, sf_dir):
    return scores(spark, sf_dir).agg(F.round(F.avg(F.col("tier").isin("Watch", "Elevated", "High").cast("int")), 6).alias("detection_rate"))


@query(SCORES + "SELECT account_id FROM scores WHERE tier IN ('High', 'Elevated')")
def expansion_candidates(spark, sf_dir):
    return scores(spark, sf_dir).where(F.col("tier").isin("High", "Elevated")).select("account_id")


@query("WITH " + POSTS + " SELECT lang, round(avg(score), 6) AS mean, max(score) AS top, count(*) FILTER (score < 0.1) AS cleared FROM posts GROUP BY lang")
def language_probe(spark, sf_dir):
    return posts(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("top"), F.count_if(F.col("score") < 0.1).alias("cleared"))


def vecs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("target_id"), F.col("embedding").alias("a"), "label"), e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("mine_id"), F.col("embedding").alias("b"))


COS = "CASE WHEN sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})) > 0 THEN least(greatest(list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))), 0), 1) ELSE 0 END"


@query("WITH t AS (SELECT vec_id AS target_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 10 <> 0), m AS (SELECT vec_id AS mine_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE vec_id % 10 = 0), s AS (SELECT target_id, mine_id, " + COS.format("a", "b") + " AS c FROM t, m) SELECT target_id, mine_id, round(c, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY c DESC, mine_id DESC) AS n FROM s) WHERE n = 1")
def nearest_neighbour(spark, sf_dir):
    t, m = vecs(spark, sf_dir)
    return nearest.best_match(t, m).withColumn("similarity", F.round("similarity", 6))


MEAN = "m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i)"


@query("WITH " + MEAN + " SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(x, 6) AS mean FROM m")
def mean_vector(spark, sf_dir):
    m = vectors.mean_vector(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return m.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


@query("WITH " + MEAN + ", c AS (SELECT label, list(x ORDER BY i) AS b FROM m GROUP BY label), e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT e.vec_id, round(" + COS.format("e.a", "c.b") + ", 6) AS similarity FROM e JOIN c ON e.label = c.label")
def cosine_to_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    joined = e.join(vectors.mean_vector(e, "embedding", "label"), "label")
    return joined.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("mean")), 6).alias("similarity"))


@query("WITH m AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) WHERE vec_id % 10 = 0 GROUP BY i), c AS (SELECT list(x ORDER BY i) AS b FROM m), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 10 <> 0) SELECT vec_id AS target_id, round(" + COS.format("e.a", "c.b") + ", 6) AS similarity FROM e, c ORDER BY " + COS.format("e.a", "c.b") + " DESC, vec_id LIMIT 3")
def nearest_to_mean(spark, sf_dir):
    t, m = vecs(spark, sf_dir)
    return nearest.nearest_to_mean(t, m).withColumn("similarity", F.round("similarity", 6))


def word_rows(spark, sf_dir):
    return topics.keywords(posts(spark, sf_dir).where("lang = 'en'"), "text", "account_id")


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '@[\\w.]+', ' ', 'g'), '[^\\p{L} ]', ' ', 'g'), '\\s+', ' ', 'g'))"
WORDS = "WITH " + POSTS + f", w AS (SELECT account_id, uri, unnest(string_split(lower({CLEAN}), ' ')) AS word FROM posts WHERE lang = 'en'), k AS (SELECT * FROM w WHERE word <> '' AND word NOT IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in stop_words()) + ")) "


@query("WITH " + POSTS + f" SELECT uri, md5({CLEAN}) AS cleaned FROM posts")
def clean_text(spark, sf_dir):
    from ..functions.text import clean_post

    return posts(spark, sf_dir).select("uri", F.md5(clean_post(F.col("text")).cast("binary")).alias("cleaned"))


@query(WORDS + "SELECT word, count(*) AS tf, count(DISTINCT uri) AS df FROM k WHERE strlen(word) >= 3 AND regexp_matches(word, '\\p{L}') GROUP BY word")
def keyword_counts(spark, sf_dir):
    return topics.word_counts(word_rows(spark, sf_dir).where(meaningful(F.col("word"))))


TOP = WORDS + """, n AS (SELECT account_id, count(DISTINCT uri) AS docs FROM k GROUP BY 1), c AS (SELECT account_id, word, count(*) AS tf, count(DISTINCT uri) AS df FROM k GROUP BY 1, 2),
s AS (SELECT c.*, tf * (ln((1 + docs) / (1 + df)::DOUBLE) + 1) AS score FROM c JOIN n ON c.account_id = n.account_id),
twice AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY round(score, 9) DESC, word) AS r2 FROM s) WHERE r2 <= 80 AND strlen(word) >= 3 AND regexp_matches(word, '\\p{L}')),
top AS (SELECT account_id, word, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY r2) AS r FROM twice) WHERE r <= 40) """


@query(TOP + "SELECT * FROM top")
def tf_idf_keywords(spark, sf_dir):
    t = topics.tf_idf(word_rows(spark, sf_dir), 40, "account_id")
    return t.select("account_id", "word", F.round("score", 6).alias("score"))


@query(TOP + ", h AS (SELECT DISTINCT k.account_id, uri, k.word FROM k JOIN top t ON k.account_id = t.account_id AND k.word = t.word) SELECT h.account_id, h.word AS a, g.word AS b, count(*) AS n FROM h JOIN h g ON h.account_id = g.account_id AND h.uri = g.uri WHERE h.word <> g.word GROUP BY 1, 2, 3")
def co_occurrence_counts(spark, sf_dir):
    w = word_rows(spark, sf_dir)
    return topics.co_occurrence(w, topics.tf_idf(w, 40, "account_id"), "account_id")


@query()
def topic_clusters(spark, sf_dir):
    w = word_rows(spark, sf_dir)
    top = topics.tf_idf(w, 40, "account_id")
    return topics.clusters(top, topics.co_occurrence(w, top, "account_id"), 7)


@query("WITH " + POSTS + ", c AS (SELECT account_id, lang AS word, count(*)::DOUBLE AS weight FROM posts GROUP BY 1, 2), m AS (SELECT word, weight FROM c WHERE account_id = 'src1'), j AS (SELECT c.account_id, sum(c.weight * coalesce(m.weight, 0)) AS d, sqrt(sum(c.weight * c.weight)) AS na FROM c LEFT JOIN m ON c.word = m.word GROUP BY 1) SELECT account_id, round(d / (na * (SELECT sqrt(sum(weight * weight)) FROM m)), 6) AS overlap FROM j")
def sparse_overlap(spark, sf_dir):
    c = posts(spark, sf_dir).groupBy("account_id", F.col("lang").alias("word")).agg(F.count("*").cast("double").alias("weight"))
    return topics.overlap(c, c.where("account_id = 'src1'").select("word", "weight")).withColumn("overlap", F.round("overlap", 6))
