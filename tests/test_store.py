"""Two writers, leases, deltas: nothing committed is lost, and what is written grows with the rows."""

import json
import os
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import classify, metrics
from tidemark.plans import phases
from tidemark.sources import queue
from tidemark.sources.store import MERGE, Conflict, Held, Store, update_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this file


@pytest.fixture
def s(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def rows(spark, *keys, value="v"):
    return spark.createDataFrame([(k, value) for k in keys], "k int, v string")


def keys(df):
    return sorted(r.k for r in df.collect())


def test_a_change_of_a_table_that_another_changed_is_refused(spark, s, monkeypatch):
    """B appends after A has read and before A commits: A is refused, and B's row stays."""
    s.replace("t", rows(spark, 1, 2))
    write, other = Store.write, Store(spark, s.root)
    calls = {
        "upsert": lambda: s.upsert("t", rows(spark, 4), ["k"]),
        "update": lambda: s.update("t", rows(spark, 1), ["k"], ["v"]),
        "delete": lambda: s.delete("t", F.col("k") == 1),
        "delete_user": lambda: s.delete_user("v", ["t"]),
        "replace_rows": lambda: s.replace_rows("t", rows(spark, 9), k=1),
    }
    s.replace("t", rows(spark, 1, 2).withColumn("user_id", F.lit("u")))
    calls["upsert"] = lambda: s.upsert("t", rows(spark, 4).withColumn("user_id", F.lit("u")), ["k"])
    calls["update"] = lambda: s.update("t", rows(spark, 1).withColumn("user_id", F.lit("u")), ["k"], ["v"])
    calls["replace_rows"] = lambda: s.replace_rows("t", rows(spark, 9).withColumn("user_id", F.lit("u")), k=1)
    for n, (name, call) in enumerate(calls.items()):

        def late(self, table, df, *by, n=n):
            monkeypatch.setattr(Store, "write", write)
            other.append("t", rows(spark, 100 + n).withColumn("user_id", F.lit("u")))
            return write(self, table, df, *by)

        monkeypatch.setattr(Store, "write", late)
        with pytest.raises(Conflict):
            call()
        assert keys(s.read("t")) == [1, 2, *range(100, 101 + n)], name
    calls["upsert"]()
    assert 4 in keys(s.read("t"))


def test_a_slow_writer_is_no_dead_one(spark, s, monkeypatch):
    """B publishes while A has written its entry and not yet published it: one of them holds, the other knows."""
    s.replace("t", rows(spark, 1))
    since, other, publish = s.state(), Store(spark, s.root), Store._publish
    mine = s.write("t", rows(spark, 2))

    def slow(self, number, said):
        monkeypatch.setattr(Store, "_publish", publish)
        other.append("t", rows(spark, 3))
        return publish(self, number, said)

    monkeypatch.setattr(Store, "_publish", slow)
    with pytest.raises(Conflict):
        s.commit({"t": [*since.tables["t"], mine]}, since)
    assert keys(s.read("t")) == [1, 3] and not [f for f in os.listdir(s.root.removeprefix("file://") + "/_log") if f.endswith("writing")]


def test_appends_at_once_all_stay(spark, s):
    s.replace("t", rows(spark, 0))
    wrong = []

    def add(n):
        try:
            Store(spark, s.root).append("t", rows(spark, n))
        except Exception as e:  # noqa: BLE001
            wrong.append(e)

    many = [threading.Thread(target=add, args=(n,)) for n in range(1, 6)]
    for t in many:
        t.start()
    for t in many:
        t.join()
    assert not wrong and keys(s.read("t")) == [0, 1, 2, 3, 4, 5]


def test_ids_of_two_appends_differ(spark, s, monkeypatch):
    """Another append comes in between: ids are given anew, none twice; nothing staged stays."""
    s.append("t", rows(spark, 1, 2), "k", "id")
    commit, other = Store.commit, Store(spark, s.root)

    def late(self, *a):
        monkeypatch.setattr(Store, "commit", commit)
        other.append("t", rows(spark, 8, 9), "k", "id")
        return commit(self, *a)

    monkeypatch.setattr(Store, "commit", late)
    got = s.append("t", rows(spark, 3), "k", "id")
    assert sorted((r.id, r.k) for r in got.collect()) == [(1, 1), (2, 2), (3, 8), (4, 9), (5, 3)]
    assert os.listdir(s.root.removeprefix("file://") + "/_staged") == []


def test_one_scan_at_a_time(spark, s):
    a = s.take_lease("scan", "a", 60)
    with pytest.raises(Held, match="a holds"):
        s.take_lease("scan", "b", 60)
    s.take_lease("sweep", "b", 60)
    a.replace("t", rows(spark, 1))
    a.renew_lease(0)  # expired, but not taken: still its own
    a.append("t", rows(spark, 2))
    b = s.take_lease("scan", "b", 60)
    with pytest.raises(Held, match="taken over"):
        a.append("t", rows(spark, 3))
    with pytest.raises(Held, match="taken over"):
        a.renew_lease(60)
    b.append("t", rows(spark, 4))
    b.give_up_lease()
    s.take_lease("scan", "a", 60).append("t", rows(spark, 5))
    assert keys(s.read("t")) == [1, 2, 4, 5]
    s.append("t", rows(spark, 6))  # who works under no lease isn't held up


def test_appended_folders_are_merged(spark, s):
    for n in range(2 * MERGE + 1):
        s.append("t", rows(spark, n))
    assert keys(s.read("t")) == list(range(2 * MERGE + 1)) and len(s.current("t")) == 3
    s.vacuum(1)
    assert len(os.listdir(s.root.removeprefix("file://") + "/t")) == 3 and s.read("t").count() == 2 * MERGE + 1


QUEUE = "account_id string, uri long, text string, score double, status string, toxic_token boolean, confidence double"


def test_queue_of_deltas(spark, s):
    """Against the queue that is rewritten: finished rows keep their verdict, all else is the newest."""
    put = lambda *r: queue.push(s, "queue", spark.createDataFrame([("a", *x) for x in r], QUEUE))
    put((1, "one", 0.5, "pending", None, None), (2, "two", 0.5, "pending", None, None), (3, "three", 0.0, "done", False, None), (1, "one", 0.5, "pending", None, None))
    tried = "account_id string, uri long, toxic_token boolean, confidence double, failure string"
    queue.judge(s, "queue", spark.createDataFrame([("a", 1, True, 0.9, None), ("a", 2, None, None, "transient"), ("b", 7, True, 1.0, None)], tried))
    put((1, "one again", 0.6, "pending", None, None), (3, "three again", 0.7, "pending", None, None), (2, "two again", 0.8, "pending", None, None))
    queue.judge(s, "queue", spark.createDataFrame([("a", 1, False, 0.1, None)], tried))
    got = [tuple(r) for r in queue.current(s, "queue").select("uri", "text", "score", "status", "toxic_token", "confidence", "failure").orderBy("uri").collect()]
    assert got == [(1, "one again", 0.6, "done", True, 0.9, None), (2, "two again", 0.8, "pending", None, None, "transient"), (3, "three again", 0.7, "done", False, None, None)]
    queue.clear(s, "queue", spark.createDataFrame([("b",)], "account_id string"))
    assert s.read("queue").where("account_id = 'b'").count() == 0 and queue.current(s, "queue").count() == 3


def pending(spark, s, n):
    queue.push(s, "queue", spark.range(n).selectExpr("'a' AS account_id", "id AS uri", "concat('text ', id) AS text", "0.5D AS score", "'pending' AS status"))


def test_what_a_drain_writes_is_linear(spark, s):
    """Twice the batches write about twice as many rows, and hold no row twice."""

    def written(n):
        pending(spark, s, n)
        before = {e for e in os.listdir(s.root.removeprefix("file://") + "/queue")}
        assert phases.drain(s, lambda r: r.withColumn("toxic_token", F.lit(False)).withColumn("confidence", F.lit(0.5)), 5) == phases.Drained("complete", n, 0)
        after = [e for e in os.listdir(s.root.removeprefix("file://") + "/queue") if e not in before]
        total = sum(spark.read.parquet(f"{s.root}/queue/{e}").count() for e in after)
        s.replace("queue", s.read("queue").where("false"))
        return total

    assert written(40) <= 2 * 40 and written(80) <= 3 * 80


def ask(texts):
    numbers = [int(t.split()[1]) for t in texts]
    if 8 in numbers:
        raise classify.Transient("busy")
    if 20 in numbers:
        raise classify.CostCapped("no more")
    if 30 in numbers:
        return [(True, 0.9)]
    return [ValueError("not a number") if n == 3 else (n % 2 == 0, 0.75) for n in numbers]


def test_failures_by_kind(spark):
    texts = spark.range(36).selectExpr("id AS _n", "id div 4 AS chunk", "concat('text ', id) AS text").repartition(3)
    got = {r._n: r for r in classify.in_chunks(texts, ask, tries=2).collect()}
    kinds = {n // 4: r.failure for n, r in got.items()}
    assert len(got) == 36 and {c: k for c, k in kinds.items() if k} == {2: "transient", 5: "cost_cap", 7: "abort"}
    assert (got[3].toxic_token, got[3].confidence, got[3].model_id) == (False, 0.0, "decode-error") and got[2].toxic_token and got[1].model_id == "model"
    assert got[8].tries == 2 and got[20].tries == 1 and got[30].detail == "1 verdicts for 4 texts"
    tried = classify.in_chunks(texts, ask, tries=2)
    rows, seen = metrics.watched(tried, metrics.classification(tried))
    assert rows.count() == 36
    want = {"texts": 36, "judged": 24, "toxic": 12, "decode_errors": 1, "retried": 4, "cost_cap": 4, "abort": 4, "transient": 4}
    assert {k: seen.get[k] for k in want} == want == {**want, "toxic": sum(bool(r.toxic_token) for r in got.values())}
    assert seen.get["abort_detail"] == "1 verdicts for 4 texts" and seen.get["transient_detail"] == "busy"
    assert classify.in_chunks(texts.where("false"), ask).count() == 0


def test_a_passing_failure_is_tried_again_at_once(spark):
    def fails_once(texts, seen=[]):  # noqa: B006
        seen.append(1)
        if len(seen) == 1:
            raise classify.Transient("busy")
        return [(False, 0.5)] * len(texts)

    got = classify.in_chunks(spark.range(3).selectExpr("id AS _n", "0 AS chunk", "'x' AS text").coalesce(1), fails_once).collect()
    assert [r.tries for r in got] == [2] * 3 and not any(r.failure for r in got)


def test_counts_of_a_stream(spark, tmp_path):
    """What the micro-batches observed adds up to a second count."""
    folder = f"file://{tmp_path}"
    spark.range(100).selectExpr("id", "id % 3 = 0 AS toxic").repartition(4).write.parquet(f"{folder}/in")
    seen = metrics.StreamCounts("judged")
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema("id long, toxic boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        stream = stream.observe("judged", F.count(F.lit(1)).alias("texts"), F.count_if("toxic").alias("toxic"))
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if seen.total["texts"] == 100:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    out = spark.read.parquet(f"{folder}/out")
    assert dict(seen.total) == {"texts": out.count(), "toxic": out.where("toxic").count()} and seen.batches == 4


def by_chunk(judge):
    return lambda rows: classify.in_chunks(rows.withColumn("chunk", F.floor(F.col("_n") / 4)), judge)


def test_drain_keeps_what_went_well_and_goes_on(spark, s):
    """A passing failure interrupts, the cost cap stops, an abort is raised; the other chunks' verdicts are kept each time."""
    pending(spark, s, 36)
    state = lambda: {r.status: r["count"] for r in queue.current(s, "queue").groupBy("status").count().collect()}
    assert phases.drain(s, by_chunk(ask), 12) == phases.Drained("interrupted", 8, 1)
    assert state() == {"done": 8, "pending": 28}
    calm = lambda texts: ask([t for t in texts if t != "text 8"] + ["text 1"] * ("text 8" in texts))
    got = phases.drain(s, by_chunk(calm), 12)
    assert got.status == "cost_capped" and state()["done"] == 8 + got.judged
    with pytest.raises(phases.BurstAborted, match="1 verdicts for"):
        phases.drain(s, by_chunk(lambda texts: calm(["text 1" if t in ("text 20", "text 8") else t for t in texts])))
    assert phases.drain(s, by_chunk(lambda texts: [(True, 0.5)] * len(texts))).status == "complete" and state() == {"done": 36}


def test_interrupted_run_is_resumed(spark, s):
    """A run that is interrupted keeps its marker; the next one, of another owner, goes on and finishes."""
    posts = spark.createDataFrame([("acc", i, i, f"a long enough text number {i}", ["en"], "original", None, 1, 1, 0.5) for i in range(8)], "account_id string, uri long, seq long, text string, langs array<string>, post_kind string, parent_uri long, likes int, reposts int, score double")

    def busy(texts):
        raise classify.Transient("busy")

    rest = (posts, posts.select("uri", "text"), spark.createDataFrame([("acc", 0.0)], "account_id string, overlap double"), posts.select("account_id").where("false"))
    assert phases.run(s, *rest, by_chunk(busy), owner="one") is None
    assert s.read("scan_state").first()["value"] == "burst" and not s.current("account_scores")
    assert phases.run(s, *rest, by_chunk(lambda t: [(True, 0.9)] * len(t)), owner="two").count() == 1
    assert json.loads(open(sorted((s.root.removeprefix("file://") + "/_log/" + f) for f in os.listdir(s.root.removeprefix("file://") + "/_log") if f.endswith("json"))[-1]).read())["leases"]["scan"]["until"] == 0


def test_update_columns_of_known_rows_only(spark):
    old = rows(spark, 1, 2)
    assert sorted(map(tuple, update_columns(old, rows(spark, 2, 3, value="w"), ["k"], ["v"]).collect())) == [(1, "v"), (2, "w"), (3, "w")]
