"""The M-tree against all pairs."""

import math

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F

from tidemark.llm import mtree

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = {}
        for own in (v for i, v in good if i == q):
            for i, v in good:
                if i != q and len(v) == len(own):
                    best[i] = max(best.get(i, -(10**40)), sum(a * b for a, b in zip(own, v, strict=True)))
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k], 1)]
    return out


def found(spark, rows, every, **how):
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(-1), "vec": F.lit("x")}).repartition(3)
    return sorted(map(tuple, mtree.search(vectors, F.col("id") % every == 0, **how).collect()))


@pytest.fixture
def small_pages(monkeypatch):
    for name, value in (("SHARE", 64), ("PAGE", 8), ("SUBTREE", 100)):
        monkeypatch.setattr(mtree, name, value)


def test_clusters_in_blocks(spark, small_pages):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(9, 6))
    rows = [(i, (middle[i % 9] + 0.1 * rng.normal(size=6)).tolist()) for i in range(600)]
    assert found(spark, rows, 20, block=17) == brute(rows, 20)


def test_odd_rows(spark, small_pages):
    """Ties, repeated ids with other vectors, other lengths, empty and zero vectors, nulls, infinities, large components."""
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 60)), [float(x) for x in rng.integers(-2, 3, size=int(rng.integers(0, 4)))]) for _ in range(200)]
    rows += [(None, [1.0]), (5, None), (5, [None]), (10, [math.nan]), (15, [math.inf]), (20, [1e5, -3.7]), (25, [0.0, 0.0]), (30, [0.0, 0.0])]
    assert found(spark, rows, 5) == brute(rows, 5)
    assert found(spark, [*rows, (35, [1e30, 1.0]), (35, [1e300])], 5) == brute(rows, 5)


def test_one_vector_on_most_rows(spark, small_pages):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(i, [1.0, 1.0]) for i in range(300, 330)]
    assert found(spark, rows, 50) == brute(rows, 50)


@pytest.mark.parametrize("rows", [[], [(5, [1.0])], [(1, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows, 5) == []


def test_bounds_save_computations():
    """In clusters, most vectors are never compared with a query whose threshold is known; what is found is exact."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 8)) * 400
    vecs = np.floor(middle[np.arange(4000) % 20] + 10 * rng.normal(size=(4000, 8))).astype(np.int64)
    most = int((vecs * vecs).sum(axis=1).max())
    pivot = mtree.lifted(vecs[:1], most)[0]
    radius, *raw = mtree.subtree(np.arange(4000), vecs, pivot, most)
    ids, flat, *rest = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, np.int32, float, float, float), strict=True))
    asked = vecs[::100]
    search = mtree.Search(np.arange(0, 4000, 100), asked, np.full(40, np.iinfo(np.int64).min), 5, most)
    search.visit(pivot, radius, ids, flat.reshape(-1, 8), *rest, np.arange(40))
    scores = asked @ vecs.T
    for n, q in enumerate(range(0, 4000, 100)):
        order = [int(i) for i in np.lexsort((np.arange(4000), -scores[n])) if i != q][:5]
        assert [(-s, i) for s, i in search.best[n]] == [(int(scores[n, i]), i) for i in order]
    assert search.computed < 0.25 * 40 * 4000


def test_exact_beyond_doubles():
    a, b = np.array([[1 << 28, 3]]), np.array([[1 << 28, 5]])
    assert mtree.products(a, b).tolist() == [[(1 << 56) + 15]]
    assert mtree.largest(64) ** 2 * 64 < 1 << 62
