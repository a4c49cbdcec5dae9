"""Discovery, service state, sweeps and nearest posts on small rows, and against brute force."""

import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from tidemark.functions import service, text
from tidemark.operators import discovery, nearest, topics
from tidemark.operators.events import pile_on


def brute(rows, seconds, least):
    found = set()
    for post in {p for p, _, _ in rows}:
        mine = [(w, t) for p, w, t in rows if p == post]
        for _, end in mine:
            who = {w for w, t in mine if end - seconds <= t <= end}
            if len(who) >= least:
                found |= who
    return found


def test_pile_on_against_brute_force(spark):
    rng = random.Random(5)
    for spread in (400, 2000, 9000):
        rows = [(rng.randrange(4), rng.randrange(9), rng.randrange(spread)) for _ in range(70)]
        df = spark.createDataFrame([(p, w, datetime.fromtimestamp(t, UTC)) for p, w, t in rows], "post long, amplifier long, ts timestamp")
        assert {r.amplifier for r in pile_on(df, 100, 4).collect()} == brute(rows, 100, 4)


def test_pile_on_edges_and_nulls(spark):
    for last, want in ((86_400, 5), (86_401, 0)):
        times = [0, 1, 2, 3, last]
        rows = [("p", f"a{i}", datetime.fromtimestamp(t, UTC)) for i, t in enumerate(times)] + [("p", "none", None)]
        assert pile_on(spark.createDataFrame(rows, "post string, amplifier string, ts timestamp")).count() == want
    assert pile_on(spark.createDataFrame([], "post string, amplifier string, ts timestamp")).count() == 0


def test_nearest_ties_blocks_and_odd_vectors(spark):
    mine = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0])], "mine_id long, b array<double>")
    targets = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [-1.0, 0.0])], "target_id long, a array<double>")
    for most in (500, 2):
        got = {r.target_id: (r.mine_id, round(r.similarity, 3)) for r in nearest.best_match(targets, mine, most).collect()}
        assert got == {1: (2, 0.999), 2: (3, 1.0), 3: (5, 0.0), 4: (5, 0.0), 5: (5, 0.0)}
    assert nearest.best_match(targets, mine.where("false")).count() == 0
    assert nearest.best_match(targets.where("false"), mine).count() == 0


def test_clean_post(spark):
    rows = [("I’m here — DON'T go @x.y http://a.b/c 3",), ("It's Über",), ("Plain ONE",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.clean_post(F.col("t"))).collect()]
    assert got == ["i am here do not go", "it is über", "Plain ONE", "", None]


def test_sizes_round_halves_to_even(spark):
    got = [r[0] for r in spark.createDataFrame([(1023,), (1280,), (1408,), (1 << 31,)], "n long").select(text.byte_size(F.col("n"))).collect()]
    assert got == ["1023 B", "1.2 KB", "1.4 KB", "2048.0 MB"]


def test_harvest_authors_and_links(spark):
    p = spark.createDataFrame([("a", 1, "hello world one"), ("a", 2, "hello world one"), ("b", 3, "Hello there you"), ("a", 4, "hello again you"), ("b", 5, None)], "account_id string, seq long, text string")
    assert sorted(r.seq for r in discovery.harvest(p, 10, "hello", 1).collect()) == [1]
    assert [r.account_id for r in discovery.authors(p, "HELLO", 5).orderBy("first_seq").collect()] == ["a", "b"]
    assert [r.account_id for r in discovery.unscored(p, p.where("account_id = 'a'")).collect()] == ["b"]
    links = spark.createDataFrame([(1, "q", "x", i) for i in range(5)], "subject long, source string, author string, seq long")
    assert sorted(r.seq for r in discovery.backlinks(links, 2).collect()) == [3, 4]


def test_search_keywords_have_three_characters(spark):
    made = spark.createDataFrame([("a", 1, ["ab", "abc"], 0.6), ("a", 2, ["x"], 0.3), ("a", 3, ["long", "y"], 0.1)], "account_id string, cluster int, keywords array<string>, weight double")
    assert [(r.position, r.keyword) for r in topics.top_keywords(made).orderBy("position").collect()] == [(1, "abc"), (2, "long")]


def test_access_and_state(spark):
    one = spark.range(1)
    row = one.select(
        service.allowed(F.lit("d"), F.lit(" ")).alias("all"),
        service.admin(F.lit("d"), F.lit("")).alias("none"),
        service.allowed(F.lit("d"), F.lit("a, d")).alias("named"),
        service.effective_user(F.lit("d"), F.lit(False), F.lit("e")).alias("refused"),
        service.shown_phase(F.lit("scoring"), F.lit(True), F.lit("odd")).alias("odd"),
        service.step_index(F.lit("idle")).alias("idle"),
        service.classified(F.lit("classifying"), F.lit(3), F.lit(5)).alias("done"),
    ).first()
    assert (row["all"], row["none"], row.named, row.refused, row.odd, row.idle, row.done) == (True, False, True, None, "scoring", 0, 0)
