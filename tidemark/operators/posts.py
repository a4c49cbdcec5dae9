"""Posts to samples, evidence and account signals. posts: account_id, uri, text, seq, post_kind, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import language, scoring

#: Of the sketch that brackets a median: its ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000

KIND_ORDER = {"original": 0, "reply": 1, "quote": 2}


def post_kind(is_reply: Column, parent: Column, is_quote: Column) -> Column:
    """A reply with a parent beats a quote; a reply without one is an original."""
    return F.when(is_reply & (F.coalesce(parent, F.lit("")) != ""), "reply").when(~is_reply & is_quote, "quote").otherwise("original")


def scan(posts: DataFrame, least_chars: int = 15) -> DataFrame:
    """Own posts long enough to be scored."""
    kept = posts.where(F.char_length("text") >= least_chars)
    return kept.where("reason is null") if "reason" in posts.columns else kept


def newest(posts: DataFrame, n: int, key: str = "account_id", order: str = "seq") -> DataFrame:
    """The n newest of each account. Spark drops what exceeds n before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return posts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def ratios(posts: DataFrame, key: str = "account_id") -> DataFrame:
    share = lambda kind: F.count_if(F.col("post_kind") == kind) / F.count("*")
    return posts.groupBy(key).agg(
        F.count("*").alias("n_posts"),
        F.count_if(F.col("post_kind") == "original").alias("n_original"),
        F.count_if(F.col("post_kind") == "reply").alias("n_reply"),
        F.count_if(F.col("post_kind") == "quote").alias("n_quote"),
        share("quote").alias("quote_ratio"),
        share("reply").alias("reply_ratio"),
    )


def with_parents(posts: DataFrame, texts: DataFrame) -> DataFrame:
    """Each post with its parent's text, if known. texts: uri, text; repeated uris count once."""
    parents = texts.groupBy(F.col("uri").alias("parent_uri")).agg(F.min("text").alias("parent_text"))
    joined = posts.where("parent_uri is not null").join(parents, "parent_uri", "left")
    # Most posts have no parent; in a join they would be one key, and all of them one task.
    alone = posts.where("parent_uri is null").withColumn("parent_text", F.lit(None).cast("string"))
    return joined.unionByName(alone)


def assess(posts: DataFrame, text: str = "text", langs: str = "langs", key: str = "account_id") -> DataFrame:
    """Accounts with their assessable and unassessable counts, ratios over the assessable, and the gate's outcome."""
    ok = language.assessable(F.col(text), F.col(langs))
    kind = lambda k: F.count_if(F.col("ok") & (F.col("post_kind") == k))
    n = F.count_if("ok")
    out = posts.withColumn("ok", ok).groupBy(key).agg(
        n.alias("assessable"),
        F.count_if(~F.col("ok")).alias("unassessable"),
        F.when(n > 0, kind("reply") / F.nullif(n, F.lit(0))).otherwise(0.0).alias("reply_ratio"),
        F.when(n > 0, kind("quote") / F.nullif(n, F.lit(0))).otherwise(0.0).alias("quote_ratio"),
    )
    return out.withColumn("outcome", language.coverage(F.col("assessable"), F.col("unassessable")))


def toxicity(posts: DataFrame, key: str = "account_id") -> DataFrame:
    """Reply-weighted toxicity from the flag ``is_toxic``."""
    reply = F.col("post_kind") == "reply"
    counts = posts.groupBy(key).agg(
        F.count_if(reply & F.col("is_toxic")).alias("tr"),
        F.count_if(reply).alias("nr"),
        F.count_if(~reply & F.col("is_toxic")).alias("to"),
        F.count_if(~reply).alias("no"),
    )
    return counts.withColumn("toxicity", scoring.weighted_toxicity(F.col("tr"), F.col("nr"), F.col("to"), F.col("no")))


def evidence(posts: DataFrame, n: int = 3, key: str = "account_id", score: str = "score") -> DataFrame:
    """The n posts of each account with the highest scores: toxic ones if it has any, else all. Ties: kind, then order."""
    order = F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])[F.col("post_kind")]
    any_toxic = posts.groupBy(key).agg(F.bool_or("is_toxic").alias("any_toxic"))
    held = posts.join(any_toxic, key).where(F.col("is_toxic") | ~F.col("any_toxic"))
    w = Window.partitionBy(key).orderBy(F.desc(score), order, "seq")
    return held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("any_toxic")


def engagement(posts: DataFrame, key: str = "account_id") -> DataFrame:
    return posts.groupBy(key).agg(F.coalesce(F.avg(F.col("likes") + F.col("reposts")), F.lit(0.0)).alias("avg_engagement"))


def median_of(rows: DataFrame, column: str, few: int = 1 << 16) -> DataFrame:
    """One row: the exact interpolated median, 0 when there is none.

    Values are never brought together: a sketch gives two values closely around
    the middle, one pass counts what lies below, on and between them, and only
    what lies between is looked at further, until ``few`` values at most are left.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    head = [r.v for r in values.limit(few + 1).collect()]
    n = len(head) if len(head) <= few else values.count()
    ranks = sorted({(n - 1) // 2, n // 2}) if n else []
    found: dict[int, float] = {}
    base, left = 0, n  # rank of the first of the values that are left, and their number
    while len(found) < len(ranks):
        wanted = [r for r in ranks if r not in found]
        if left <= few:
            last = sorted(head) if left == n else [r.v for r in values.orderBy("v").collect()]
            found |= {r: last[r - base] for r in wanted}
            break
        around = [(wanted[0] - base) / left - 2 / ACCURACY, (wanted[-1] - base + 1) / left + 2 / ACCURACY]
        a, b = values.agg(F.percentile_approx("v", [min(max(x, 0.0), 1.0) for x in around], ACCURACY)).first()[0]
        v = F.col("v")
        counts = values.agg(F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & (b > a))).first()
        parts = [(v < a, None), (v == a, a), ((v > a) & (v < b), None), ((v == b) & (b > a), b), (v > b, None)]
        start = base
        for (where, value), size in zip(parts, [*counts, base + left], strict=True):
            inside = [r for r in wanted if start <= r < start + size]
            if value is not None:
                found |= dict.fromkeys(inside, value)
            elif inside:  # of one part only: its neighbours are values that are there
                values, rest = values.where(where), (start, min(size, base + left - start))
            start += size
        if len(found) < len(ranks):
            base, left = rest
    middle = sum(found.values()) / len(found) if found else 0.0
    return rows.sparkSession.createDataFrame([(float(middle),)], "median double")


def fingerprint_posts(posts: DataFrame, least: int = 15, key: str = "account_id") -> DataFrame:
    """Originals only for accounts that have ``least``, else all posts."""
    n = posts.groupBy(key).agg(F.count_if(F.col("post_kind") == "original").alias("_n"))
    return posts.join(n, key).where((F.col("_n") < least) | (F.col("post_kind") == "original")).drop("_n")


def early_exit(first_person: DataFrame, overlap: Column, gate: float = 0.15, key: str = "account_id") -> DataFrame:
    """Accounts that need no second look: five scores at least, all clean, and little overlap."""
    s = first_person.groupBy(key).agg(F.count("score").alias("n"), F.max("score").alias("top"), F.first(overlap).alias("overlap"))
    return s.withColumn("early_exit", (F.col("n") >= 5) & F.col("overlap").isNotNull() & (F.col("overlap") < gate) & (F.col("top") < scoring.CLEAN))


def stage1(posts: DataFrame, first_person: DataFrame, overlap: Column, key: str = "account_id") -> DataFrame:
    """What the first look at an account comes to: NotAssessed, InsufficientData, Low (no second look) or Proceed, in one column."""
    gate = assess(posts, key=key).select(key, "outcome", "assessable")
    seen = early_exit(first_person, overlap, key=key).select(key, "early_exit")
    outcome = F.when(F.col("outcome") == "NotAssessed", "NotAssessed").when(F.col("outcome") != "Score", "InsufficientData").when(F.col("early_exit"), "Low").otherwise("Proceed")
    return gate.join(seen, key, "left").select(key, "assessable", outcome.alias("stage1"))


def top_pairs(pairs: DataFrame, n: int, key: str = "account_id", score: str = "similarity", order: str = "uri") -> DataFrame:
    """The n pairs of each account that are most alike, with their rank; ties by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(score), order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def in_input_order(results: DataFrame, inputs: DataFrame, key: str) -> DataFrame:
    """Results that came in any order, in that of ``inputs`` (key, position); a key that was asked twice is answered twice, one without a result has nulls."""
    return inputs.join(results, key, "left").orderBy("position")
