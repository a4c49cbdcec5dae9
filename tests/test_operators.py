import math
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hints, text
from tidemark.functions.stopwords import stop_words
from tidemark.operators import events, posts, topics, verdicts
from tidemark.plans import amplification, context, phases, report, sweep
from tidemark.sources import records, store
from tidemark.streaming import limits

DAY0 = datetime(2024, 1, 1)


def pile_on(spark, rows):
    df = spark.createDataFrame([(w, p, DAY0 + timedelta(seconds=s)) for w, p, s in rows], "amplifier string, post string, ts timestamp")
    return {r[0] for r in events.pile_on(df).collect()}


def test_pile_on(spark):
    h = 3600
    assert pile_on(spark, [(c, "p", i * h) for i, c in enumerate("abcd")]) == set()
    assert pile_on(spark, [(c, "p", i * h) for i, c in enumerate("abcde")]) == set("abcde")
    assert pile_on(spark, [(c, "p", i * 12 * h) for i, c in enumerate("abcde")]) == set()
    assert pile_on(spark, [(c, "p", i * h) for i, c in enumerate("abcda")]) == set()
    assert pile_on(spark, [(c, "p" if c < "d" else "q", i) for i, c in enumerate("abcdef")]) == set()
    assert pile_on(spark, [(c, "p", t) for c, t in zip("abcde", (0, 1, 2, 3, 86400), strict=True)]) == set("abcde")
    assert pile_on(spark, [(c, "p", t) for c, t in zip("abcde", (0, 1, 2, 3, 86401), strict=True)]) == set()


def test_enqueue_keeps_verdicts(spark):
    kind = "k int, text string, status string, toxic_token boolean"
    old = spark.createDataFrame([(1, "a", "done", True), (2, "b", "pending", None), (4, "d", "done", False)], kind)
    new = spark.createDataFrame([(1, "A", "pending", None), (2, "B", "pending", None), (3, "C", "pending", None)], kind)
    got = sorted(tuple(r) for r in store.enqueue(old, new, ["k"]).collect())
    assert got == [(1, "A", "done", True), (2, "B", "pending", None), (3, "C", "pending", None), (4, "d", "done", False)]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.upsert("t", spark.createDataFrame([("u", 1, 1), ("u", 1, 2)], "user_id string, k int, v int"), ["user_id", "k"], "v")
    assert [tuple(r) for r in s.read("t").collect()] == [("u", 1, 2)]
    s.upsert("t", spark.createDataFrame([("w", 1, 5), ("u", 1, 7)], "user_id string, k int, v int"), ["user_id", "k"])
    s.delete_user("u", ["t", "missing"])
    assert [tuple(r) for r in s.read("t").collect()] == [("w", 1, 5)]
    with pytest.raises(LookupError):
        s.update("t", spark.createDataFrame([("x", 9, 0)], "user_id string, k int, v int"), ["user_id", "k"], ["v"])


def test_a_killed_writer_loses_nothing(spark, tmp_path, monkeypatch):
    """Death before, in and after the log entry: what was committed holds, and the next writer goes on from it."""
    s = store.Store(spark, f"file://{tmp_path}")
    rows = lambda *v: spark.createDataFrame([(x, x) for x in v], "k int, v int")
    s.replace("t", rows(*range(50)))
    monkeypatch.setattr(store.Store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        s.replace("t", rows(99))
    monkeypatch.undo()
    assert s.read("t").count() == 50
    (tmp_path / "_log" / "half.writing").write_text('{"tables": {"t": ["t/')
    assert s.read("t").count() == 50
    seen = s.read("t")
    assert s.upsert("t", rows(49, 50), ["k"]).count() == 51 and seen.count() == 50
    s.append("t", rows(51))
    assert s.read("t").count() == 52 and len(s.current("t")) == 2
    since = s.state()
    s.append("t", rows(52))
    with pytest.raises(RuntimeError):
        s.commit({"t": None}, since)
    s.vacuum(1)
    assert s.read("t").count() == 53 and store.Store(spark, f"file://{tmp_path}").names() == ["t"]


def test_ids_without_gap(spark, tmp_path):
    """Wide rows, many partitions, ties, over two appends."""
    s = store.Store(spark, f"file://{tmp_path}")
    rows = spark.range(40_000).select((F.col("id") % 500).alias("k"), *[F.md5((F.col("id") * i).cast("string").cast("binary")).alias(f"c{i}") for i in range(8)])
    s.append("t", rows, "k", "n")
    got = s.append("t", rows.limit(1000), "k", "n")
    assert got.agg(F.count_distinct("n"), F.min("n"), F.max("n"), F.count("n")).first()[:] == (41_000, 1, 41_000, 41_000)
    assert got.where("n <= 40000").selectExpr("count_if(k <> floor((n - 1) / 80))").first()[0] == 0


def sample(spark):
    rows = [("acc", i, i, f"a long enough text number {i}", ["en"], "reply" if i % 2 else "original", None, 1, 1, 0.5 if i % 4 == 1 else 0.05) for i in range(12)]
    return spark.createDataFrame(rows, "account_id string, uri long, seq long, text string, langs array<string>, post_kind string, parent_uri long, likes int, reposts int, score double")


def test_phases_resume(spark, tmp_path):
    p, s = sample(spark), store.Store(spark, f"file://{tmp_path}")
    seen = []

    def classify(rows):
        seen.append(rows.count())
        return rows.withColumn("toxic_token", F.lit(True)).withColumn("confidence", F.lit(0.9))

    rest = (p.select("uri", "text"), spark.createDataFrame([("acc", 0.0)], "account_id string, overlap double"), p.select("account_id").where("false"), classify)
    assert phases.run(s, p, *rest, stop_after="gather") is None and not seen
    r = phases.run(s, p, *rest).first()
    assert seen == [3] and r.toxicity == pytest.approx(0.35) and r.score == pytest.approx(9.40625) and r.tier == "Watch"
    assert phases.run(s, p, *rest).count() == 1 and seen == [3]
    assert "| 1 | acc |" in report.markdown(s.read("account_scores"), posts.evidence(p.withColumn("is_toxic", F.lit(False))))
    s.replace("scan_state", spark.createDataFrame([("nonsense",)], "value string"))
    with pytest.raises(ValueError):
        phases.run(s, p, *rest)


def test_clusters(spark):
    p = spark.createDataFrame([("a", 1, "cats dogs birds"), ("a", 2, "cats dogs"), ("a", 3, "taxes money")], "account_id string, uri int, text string")
    w = topics.keywords(p, "text", "account_id")
    top = topics.tf_idf(w, 10, "account_id")
    made = topics.clusters(top, topics.co_occurrence(w, top, "account_id"), 5).orderBy("cluster").collect()
    assert sum(r.weight for r in made) == pytest.approx(1) and set(made[0].keywords) == {"cats", "dogs", "birds"}
    assert [r.weight for r in made] == sorted((r.weight for r in made), reverse=True)


def test_records(spark):
    raw = spark.createDataFrame([('{"relationships":[{"did":"a","following":"x","followedBy":"y"},{"did":"b","followedBy":"y"},{"did":"c"}]}',), ("{}",)], "j string")
    assert [tuple(r) for r in records.relationships(raw, "j").collect()] == [("a", "Mutual follow"), ("b", "Follows you"), ("c", "Stranger")]


def test_limiter(spark):
    ok, _, _ = limits.allow([0, 1, 2, 9, 10, 11], None, 0, 3, 10)
    assert ok == [True, True, True, False, True, True]
    rows = spark.createDataFrame([("k", DAY0 + timedelta(seconds=i)) for i in range(4)], "key string, ts timestamp")
    assert [r.allowed for r in limits.limited_batch(rows, 2, 10).orderBy("ts").collect()] == [True, True, False, False]


def test_early_exit_and_split(spark):
    p = sample(spark)
    clean, rest = verdicts.split_clean(p)
    assert (clean.count(), rest.count()) == (9, 3)
    assert posts.early_exit(p.where("post_kind = 'original'"), F.lit(0.1)).first().early_exit


def test_one_bad_text_costs_its_own_score_only(spark):
    def score(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no score")
        return [0.25] * (len(texts) + (len(texts) > 2))

    assert verdicts.one_by_one(score, []) == []
    assert verdicts.one_by_one(score, ["a", "bad", "b"]) == [0.25, None, 0.25]
    assert verdicts.one_by_one(score, ["a", "b", "c"]) == [0.25] * 3
    rows = spark.createDataFrame([(1, "a", 9.0), (2, "bad one", 9.0), (3, None, 9.0), (4, "d", 9.0)], "uri int, text string, score double").repartition(2)
    got = {r.uri: r.score for r in verdicts.clean_pass(rows, score, batch=3).collect()}
    assert got == {1: 0.25, 2: None, 3: None, 4: 0.25}
    assert verdicts.clean_pass(rows.where("false"), score).count() == 0


def test_drain_in_batches_and_recovery(spark, tmp_path):
    """Batches until none is pending; rows without a verdict are asked for again once, by recovery; then the account is skipped."""
    p, s = sample(spark), store.Store(spark, f"file://{tmp_path}")
    other = p.withColumns({"account_id": F.lit("mute"), "uri": F.col("uri") + 100})
    both = p.unionByName(other)
    seen = []

    def classify(rows):
        seen.append(sorted(r.uri for r in rows.collect()))
        return rows.withColumn("toxic_token", F.when(F.col("uri") < 100, True)).withColumn("confidence", F.lit(0.9))

    overlap = spark.createDataFrame([("acc", 0.0), ("mute", 0.0)], "account_id string, overlap double")
    got = phases.run(s, both, both.select("uri", "text"), overlap, both.select("account_id").where("false"), classify, batch=2)
    assert [r.account_id for r in got.collect()] == ["acc"] and [r.account_id for r in s.read("scan_skips").collect()] == ["mute"]
    assert [len(x) for x in seen] == [2, 2, 2, 2, 1] and seen[3] + seen[4] == [101, 105, 109]
    s.replace("queue", s.read("queue").withColumn("status", F.lit("pending")))
    before = len(seen)
    assert phases.drain(s, classify, 2, lambda n: False).status == "cost_capped" and len(seen) == before


def test_report(spark):
    scores = spark.createDataFrame([("a|b", 40.0, "High"), ("c", 3.0, "Low")], "account_id string, score double, tier string")
    shown = spark.createDataFrame([("a|b", "so | bad", 1), ("c", "fine", 1)], "account_id string, text string, rank int")
    clusters = spark.createDataFrame([("cats / dogs", ["cats", "dogs"], 0.5)], "label string, keywords array<string>, weight double")
    said = spark.createDataFrame([("q", "quote", DAY0, "look"), ("r", "quote", DAY0, ""), ("s", "like", DAY0, "x")], "amplifier string, event_type string, ts timestamp, text string")
    got = report.markdown(scores, shown, clusters=clusters, events=said, not_assessed=2)
    assert "- cats / dogs ========== 50%: cats, dogs" in got and "- 2024-01-01 q: look" in got and "2 accounts could not" in got
    assert "fine" not in got and "- r" not in got and "- s" not in got


def test_topic_sweep(spark):
    none = spark.createDataFrame([], "account_id string")
    people = spark.createDataFrame([("a",), ("b",), ("b",)], "account_id string")

    def search(k, n):
        if k == "down":
            raise OSError("search failed")
        return people

    found, failed = sweep.topic_sweep(["x", "down"], search, spark.createDataFrame([("a",)], "account_id string"))
    assert [r.account_id for r in found.collect()] == ["b"] and failed == ["down"]
    with pytest.raises(RuntimeError):
        sweep.topic_sweep(["down"], search, none)
    assert sweep.topic_sweep([], search, none)[0].count() == 0


def test_events_recorded_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    kind = "amplifier string, post string, event_type string, uri string, ts timestamp"
    rows = [("a", "p", "like", "1", DAY0), ("a", "p", "like", "2", DAY0 + timedelta(1)), ("a", "p", "quote", "3", DAY0 + timedelta(2))]
    assert [r.uri for r in amplification.record(s, spark.createDataFrame(rows, kind)).orderBy("event_id").collect()] == ["1", "3"]
    more = [("a", "p", "like", "9", DAY0), ("b", "p", "like", "4", DAY0 + timedelta(3))]
    assert [(r.event_id, r.uri) for r in amplification.record(s, spark.createDataFrame(more, kind)).orderBy("event_id").collect()] == [(1, "1"), (2, "3"), (3, "4")]


def test_contexts_by_gate(spark):
    """Direct pairs of amplifiers; inferred ones only of accounts at Watch or more."""
    first = spark.createDataFrame([("amp", 1.0), ("watch", 8.0), ("low", 7.9)], "account_id string, score double")
    direct = spark.createDataFrame([("amp", "mine", "yours")], "account_id string, original string, response string")
    targets = spark.createDataFrame([("watch", 1, "t", [1.0, 0.0]), ("low", 2, "t", [1.0, 0.0])], "account_id string, target_id int, text string, a array<double>")
    mine = spark.createDataFrame([(1, "near", [1.0, 0.1]), (2, "far", [0.0, 1.0])], "mine_id int, text string, b array<double>")
    score = lambda pairs: pairs.withColumn("hostility", F.when(F.col("original") == "near", 0.5).otherwise(0.25))
    got = {r.account_id: r.context for r in context.contexts(first, direct, targets, mine, score).collect()}
    assert got == {"amp": 0.25, "watch": 0.5}


def test_fingerprint_and_stop_words(spark):
    words = set(stop_words())
    assert {"the", "really", "getting", "went", "repost", "lot's", "means", "looked", "isn"} <= words and len(words) == len(stop_words())
    # Only the words themselves: no forms by rule.
    assert not {"climate", "geted", "goed", "tryed", "comed", "finding", "meaning", "changes", "works", "calls", "starts"} & words
    rows = [("a", i, f"the climate really warms number{i} and the reefs", "original") for i in range(16)] + [("a", 99, "reply words", "reply")]
    posts_ = spark.createDataFrame(rows, "account_id string, uri int, text string, post_kind string")
    made, mean = topics.fingerprint(posts_, spark.createDataFrame([(i, [float(i), 1.0]) for i in range(16)], "uri int, vector array<double>"))
    r = made.collect()
    assert all(x.post_count == 16 for x in r) and "climate" in {w for x in r for w in x.keywords} and not {"the", "really", "words"} & {w for x in r for w in x.keywords}
    assert list(mean.first()["mean"]) == [7.5, 1.0]


def test_lines_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x\ty")], "k int, v string")
    for kind in ("jsonl", "tsv"):
        records.write_lines(rows, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.json(f"file://{tmp_path}/jsonl").first()["v"] == "x\ty"
    assert spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/tsv").count() == 1
    with pytest.raises(ValueError):
        records.write_lines(rows, str(tmp_path), "xml")


def test_category_hints(spark):
    """The first category counts; keywords are found inside words and in any case of the text, those with capitals never."""
    cases = [
        ("SCUM, I love you", "dehumanization"), ("I disagree, we all do", "dogpile"), ("So PROUD OF you", "support"), ("a rational mind", "dogpile"),
        ("TERF", None), ("I worry about it", None), ("I worry that it rains", "concern-troll"), ("", None), (None, None), ("Actually, no", "disagreement"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", text.first_match(F.col("t"), hints.CATEGORIES).alias("c"))
    assert [r.c for r in rows.orderBy("i").collect()] == [c for _, c in cases]


def test_posts_without_parents_are_not_joined(spark):
    """Posts without a parent go past the join, in which they would be one key."""
    rows = [(i, f"t{i}", i - 1 if i % 3 == 1 else None) for i in range(300)] + [(300, "x", 999)]
    p = spark.createDataFrame(rows, "uri long, text string, parent_uri long")
    made = posts.with_parents(p, p.select("uri", "text"))
    assert {r.uri: r.parent_text for r in made.collect()} == {u: f"t{q}" if q is not None and q < 300 else None for u, _, q in rows}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter") :].splitlines()[1]
    assert "isnotnull(parent_uri" in left


def test_clean_pass_makes_few_texts_objects_at_a_time():
    """A long Arrow batch is taken a call's texts at a time, nulls and failures in their places."""
    texts = [None if i % 5 == 0 else "x" * i for i in range(100)]

    def score(some):
        if any(len(t) == 7 for t in some):
            raise ValueError
        return [float(len(t)) for t in some]

    whole = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["i", "text"])
    got = list(verdicts.scored_batches(score, "text", 16)(iter([whole])))
    assert [b.num_rows for b in got] == [16] * 6 + [4]
    assert pa.Table.from_batches(got)["score"].to_pylist() == [None if i % 5 == 0 or i == 7 else float(i) for i in range(100)]


def test_direct_pairs_move_one_text_a_row(spark, monkeypatch):
    """Equal texts of different posts, repeated answers and empty texts: the distinct pairs, whether the answered texts fit in a task or not; no shuffle is by both texts."""
    events = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (1, 10, "b"), (2, 12, "a"), (2, 13, "a"), (3, 10, ""), (3, 10, None), (4, 99, "a"), (5, None, "a"), (2, 14, "a")], "amplifier int, post int, text string")
    originals = spark.createDataFrame([(10, "x"), (11, "x"), (12, "y"), (12, "z"), (13, ""), (14, None), (50, "x"), (10, "x")], "post int, text string")
    want = [(1, "x", "a"), (1, "x", "b"), (2, "y", "a"), (2, "z", "a")]
    for posts, size in ((1 << 14, 1 << 25), (1 << 14, 1), (0, 1 << 25)):
        monkeypatch.setattr(context, "FEW_POSTS", posts)
        monkeypatch.setattr(context, "FEW_BYTES", size)
        pairs = context.direct_pairs(events, originals)
        assert sorted(tuple(r) for r in pairs.collect()) == want
        assert sorted(tuple(r) for r in context.pairs_counted(context.answered(events, originals)[0]).collect()) == [(1, 2), (2, 2)]
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert not any("Aggregate [" in x and "original#" in x.split("]")[0] and "response#" in x.split("]")[0] for x in plan.splitlines()), plan


def test_words_are_counted_in_their_post(spark):
    """A post in several rows is one post; no table of every post's words is grouped or kept."""
    rows = [("a", 1, "apple apple pear"), ("a", 1, "pear fig"), ("a", 2, "apple"), ("a", 3, None), ("a", 4, "the"), ("b", 1, "apple"), ("b", 2, "")]
    w = topics.keywords(spark.createDataFrame(rows, "account_id string, uri int, text string"), "text", "account_id")
    got = topics.tf_idf(w, 10, "account_id")
    assert sorted((r.account_id, r.word, r.tf, r.df) for r in got.collect()) == [("a", "apple", 3, 2), ("a", "fig", 1, 1), ("a", "pear", 2, 1), ("b", "apple", 1, 1)]
    apple = {r.account_id: r.score for r in got.collect() if r.word == "apple"}
    assert apple["a"] == pytest.approx(3 * (math.log(3 / 3) + 1)) and apple["b"] == pytest.approx(1)
    assert sorted((r.a, r.b, r.n) for r in topics.co_occurrence(w, got, "account_id").collect()) == [(x, y, 1) for x in ("apple", "fig", "pear") for y in ("apple", "fig", "pear") if x != y]
    grouped = [x.split("Aggregate [")[1].split("]")[0] for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert grouped and not any("uri#" in x and "word#" in x for x in grouped)
