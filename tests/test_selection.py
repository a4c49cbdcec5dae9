"""Medians and nearest posts that no single task holds, against the plain ways."""

import random
import statistics

import numpy as np
import pytest

from tidemark.operators import nearest
from tidemark.operators.posts import median_of


@pytest.mark.parametrize("few", [1 << 16, 10])
def test_median(spark, few):
    rng = random.Random(1)
    tables = [
        [], [3.0], [1.0, 2.0], [5.0] * 300, [1.0] * 200 + [2.0] * 200, [1.0] * 200 + [2.0] * 201, [rng.gauss(0, 1) for _ in range(999)],
        [rng.choice([1.0, 1e-300, -1e300, 7.0]) for _ in range(500)], [7.0] * 300 + [rng.random() * 20 for _ in range(600)], [*range(100), None, None],
    ]
    for values in tables:
        got = median_of(spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double"), "x", few).collect()
        there = [v for v in values if v is not None]
        assert [r.median for r in got] == [pytest.approx(statistics.median(there) if there else 0.0)], values[:5]


def vectors(rng, n, ids):
    out = [(next(ids), [float(x) for x in rng.normal(size=6)]) for _ in range(n)]
    return out + [(next(ids), None), (next(ids), []), (next(ids), [0.0] * 6), (next(ids), [1.0, 2.0]), (next(ids), [-1.0, -2.0, 3.0])]


def test_blocks_give_what_one_matrix_gives(spark):
    """More of mine than may be broadcast: several blocks on both sides; ties, odd vectors, repeated rows."""
    rng = np.random.default_rng(1)
    targets, mine = vectors(rng, 150, iter(range(1000))), vectors(rng, 90, iter(range(5000, 6000)))
    mine += [(i + 3000, v) for i, v in mine[:20]]
    targets += [(900, mine[3][1]), (901, [-x for x in mine[3][1]])]
    t, m = spark.createDataFrame(targets, "target_id long, a array<double>"), spark.createDataFrame(mine, "mine_id long, b array<double>")
    key = lambda df: sorted((r.target_id, r.mine_id, round(r.similarity, 9)) for r in df.collect())
    whole = key(nearest.best_match(t, m))
    assert len(whole) == len(targets)
    assert key(nearest.best_match(t, m, most=50, block=16)) == whole
    named = m.selectExpr("concat('p', mine_id) AS mine_id", "b")
    assert [r.mine_id for r in nearest.best_match(t.where("target_id = 900"), named, most=50, block=16).collect()] == [f"p{mine[3][0] + 3000}"]
    assert nearest.best_match(t, m.where("false")).count() == 0


def test_blocks_are_not_broadcast(spark):
    """Beyond the most that is broadcast, no side is joined: the plan broadcasts the one row of the last of mine, and the rows that meet a part grow with the parts only."""
    rng = np.random.default_rng(2)
    vectors = lambda name, ids, col: spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in ids], f"{name} long, {col} array<double>")
    t, m = vectors("target_id", range(300), "a"), vectors("mine_id", range(1000, 1200), "b")
    plan = nearest.best_match(t, m, most=50)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "Join" in x and "Cross" not in x] == []
    assert nearest.best_match(t, m, most=50, block=40).select("target_id").distinct().count() == 300
