"""Feeds in pages: cut-off, resume, pages that needn't be read aren't; a stream of new pages."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import posts, verdicts
from tidemark.plans import steps, sweep
from tidemark.sources import paged, queue, records
from tidemark.sources.store import Store

A_B = [(a, s) for a in "ab" for s in range(10)]


def put(root, author, number, seqs, cursor, raw=None):
    folder = root / f"author={author}" / f"page={number:08d}"
    folder.mkdir(parents=True)
    items = [{"seq": s, "uri": f"{author}{s}", "text": "x"} for s in seqs]
    (folder / "page.json").write_text(raw or json.dumps({"cursor": cursor, "items": items}))


@pytest.fixture
def feeds(tmp_path):
    for a in "ab":
        put(tmp_path, a, 0, [1, 0], None)
        put(tmp_path, a, 1, [4, 3, 2], 0)
        put(tmp_path, a, 2, [9, 8, 7, 6, 5], 1)
    return tmp_path


def got(df):
    return sorted((r.author, r.seq) for r in df.collect())


def test_whole_feeds(spark, feeds):
    f = paged.feed(spark, f"file://{feeds}")
    assert got(f) == A_B and {(r.page, r.uri) for r in f.where("seq = 3").collect()} == {(1, "a3"), (1, "b3")}
    assert got(paged.feed(spark, f"file://{feeds}", "seq long, author string")) == A_B


def test_unneeded_pages_are_not_read(spark, feeds):
    """Reading a broken page fails; a cut-off, a filter on the author or on seq keep clear of it."""
    (feeds / "author=b" / "page=00000000" / "page.json").write_text("broken")
    with pytest.raises(Exception, match="(?s)JSON"):
        paged.feed(spark, f"file://{feeds}").count()
    assert got(paged.feed(spark, f"file://{feeds}", most=7)) == [(a, s) for a, s in A_B if s > 2]
    f = paged.feed(spark, f"file://{feeds}")
    assert got(f.where("author = 'a'")) == A_B[:10]
    assert got(f.where("seq > 3")) == [(a, s) for a, s in A_B if s > 3]
    assert got(f.where("author = 'b' and seq >= 5")) == A_B[15:]


def test_resume_by_cursor(spark, feeds):
    assert got(paged.feed(spark, f"file://{feeds}", cursor=1)) == [(a, s) for a, s in A_B if s < 5]
    assert paged.feed(spark, f"file://{feeds}/none").count() == 0


def test_stream_of_pages(spark, feeds, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('out')}"
    spark.dataSource.register(paged.PagedFeed)

    def take():
        stream = spark.readStream.format("paged_feed").option("path", f"file://{feeds}").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(once=True).start().awaitTermination()
        return got(spark.read.parquet(f"{out}/rows"))

    assert take() == A_B
    put(feeds, "b", 3, [11, 10], 2)
    put(feeds, "c", 3, [0], None)
    assert take() == sorted([*A_B, ("b", 10), ("b", 11), ("c", 0)])


def test_typed_records(spark):
    raw = spark.createDataFrame([(1, '{"uri": "u1", "value": {"subject": "s", "createdAt": "2024-01-02T00:00:00Z"}}'), (2, '{"uri": "u2", "value": {"subject": "t", "createdAt": "2024-01-03T00:00:00Z"}}'), (3, '{"uri": "u3", "value": {"createdAt": 5}}'), (4, "{half"), (5, None), (6, '{"uri": "u6", "value": {"subject": "v", "createdAt": "never"}}')], "k int, j string")
    good, bad = records.blocks(raw, "j")
    assert [r.uri for r in good.collect()] == ["u2", "u1", "u6"] and [r.k for r in bad.collect()] == [4]
    assert [r.uri for r in records.blocks(raw, "j", 1)[0].collect()] == ["u2"]
    made = {r.k: (r.n, r.malformed) for r in records.typed(spark.createDataFrame([(1, '{"n": 3}'), (2, '{"n": "x"}'), (3, "{}"), (4, "["), (5, None)], "k int, j string"), "j", {"n": ("$.n", "int")}).collect()}
    assert made == {1: (3, False), 2: (None, False), 3: (None, False), 4: (None, True), 5: (None, False)}


def test_threads_by_depth(spark):
    p = spark.createDataFrame([(2, 1, "a"), (3, 1, "b"), (4, 2, "c"), (5, 4, "d"), (6, 9, "e")], "uri long, parent_uri long, text string")
    roots = spark.createDataFrame([(1,)], "uri long")
    assert sorted((r.uri, r.depth) for r in records.replies_to(p, roots, 2).collect()) == [(2, 1), (3, 1), (4, 2)]


def test_input_order_and_prompts(spark):
    asked = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("z", 3)], "uri string, position int")
    found = spark.createDataFrame([("a", 1), ("b", 2)], "uri string, v int")
    assert [(r.uri, r.v) for r in posts.in_input_order(found, asked, "uri").collect()] == [("b", 2), ("a", 1), ("b", 2), ("z", None)]
    row = spark.range(1).select(text.filled("<P>: {x} <C>", {"<P>": F.lit("say <C>"), "<C>": F.lit("<P>")}).alias("t")).first()
    assert row.t == "say <C>: {x} <P>"
    with pytest.raises(ValueError, match="once"):
        text.filled("<P>", {"<P>": F.lit(1), "<C>": F.lit(2)})


def test_an_account_that_fails_is_alone(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 2), ("c", 4)], "account_id string, n int")
    made = verdicts.each_account(rows, lambda f: f.head(1).assign(share=[1 / int(f.n.iloc[0])])[["share"]], "share double", most=1)
    assert {r.account_id: (r.share, r.error and r.error.split(":")[0]) for r in made.collect()} == {"a": (1.0, None), "b": (None, "ZeroDivisionError"), "c": (None, "ValueError")}


def test_steps_are_done_once(spark, tmp_path):
    """Killed in and after a step: what it made and that it is done go together; another run id begins anew."""
    s, calls = Store(spark, f"file://{tmp_path}"), []
    one = lambda n: spark.createDataFrame([(n,)], "n int")

    def second(at, fail):
        calls.append("second")
        if fail:
            raise KeyboardInterrupt
        return {"b": s.read("a", at).select((F.col("n") + 1).alias("n"))}

    def run(run_id, stop=None, fail=False):
        return steps.go_on(s, "job", run_id, [("first", lambda at: calls.append("first") or {"a": one(1)}), ("second", lambda at: second(at, fail))], stop)

    assert not run("x", stop="first") and calls == ["first"]
    with pytest.raises(KeyboardInterrupt):
        run("x", fail=True)
    assert s.current("b") is None
    assert run("x") and run("x") and calls == ["first", "second", "second"] and s.read("b").first().n == 2
    assert run("y") and calls[3:] == ["first", "second"]
    s.replace("job_state", spark.createDataFrame([("y", "third")], "run_id string, step string"))
    with pytest.raises(ValueError, match="third"):
        run("y")


def test_a_sweep_is_scored(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    p = spark.createDataFrame([(a, i, i, f"a long enough text number {i}", ["en"], "original", None, 1, 1, 0.5) for a, n in (("found", 0), ("other", 20)) for i in range(n, n + 6)], "account_id string, uri long, seq long, text string, langs array<string>, post_kind string, parent_uri long, likes int, reposts int, score double")
    rest = (p, p.select("uri", "text"), p.select("account_id").distinct().withColumn("overlap", F.lit(0.0)))
    yes = lambda r: r.withColumn("toxic_token", F.lit(True)).withColumn("confidence", F.lit(0.9))
    found = spark.createDataFrame([("found",), ("found",)], "account_id string")
    assert [r.account_id for r in sweep.scored(s, found, *rest, yes).collect()] == ["found"]
    assert [r.account_id for r in sweep.scored(s, p.select("account_id"), *rest, yes).collect()] == ["found"] and queue.current(s, "queue").count() == 6
