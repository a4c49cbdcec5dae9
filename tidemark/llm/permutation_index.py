"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. The index is made of
shards: each holds some vectors and, for every pivot, an inverted file of the
vectors that have it among their NEAREST, with its rank there. The file of a
pivot is thus spread over all shards, however popular the pivot is. A query
visits the files of its own VISITED nearest pivots and adds up, by vector, what
each shared pivot takes off the footrule distance between the two permutations;
vectors in none of these files aren't looked at. The best share of every shard
is reranked by exact distance in double precision, and the shards' best are
merged.

Pivots are a bounded sample (PIVOTS vectors in the order of a hash). Queries
are taken in blocks of about QUERY_BLOCK: one block at a time is on the driver
and broadcast, and what it finds is written before the next. Of vectors that are
equal in all components only the k + 1 smallest ids are posted: no other can be
among k results of any query, as ties go to smaller ids.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part; vectors of each length are an index of their
own, as distance is defined between equal lengths only; rows that repeat id and
vector count once; an id with several vectors counts by the nearest of them; a
null id takes no part; an empty table, or one without queries, gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, keep

PIVOTS = 512
#: Pivots that a vector is posted under, and of a query that are visited.
NEAREST = 128
VISITED = 128
SHARD = 4096
QUERY_BLOCK = 4096
#: Share of a shard that is reranked, and vectors of a shard for each result that is asked for, at least.
SHARE = 0.08
EACH = 10


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)


def order(vecs: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m nearest pivots of each vector, nearest first; ties to the smaller pivot."""
    far = (pivots * pivots).sum(axis=1) - 2 * vecs @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :m].astype(np.int32)


def footrule_saved(m: int, rank: int, ranks: np.ndarray) -> np.ndarray:
    """Half of what a pivot at ``rank`` and at ``ranks`` takes off the footrule distance of two permutations cut at m."""
    return m - np.maximum(ranks, rank)


def _vectors(column, dim: int) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column.values
    return np.asarray(flat, np.float64).reshape(-1, dim)


def build(vectors: DataFrame, pivots: np.ndarray, m: int) -> DataFrame:
    """Index shards from (id, vec): ids, vectors, and the inverted files laid end to end."""
    dim = pivots.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                ids = np.asarray(part.column(0), np.int64)
                by_id = np.argsort(ids, kind="stable")
                ids, vecs = ids[by_id], _vectors(part.column(1), dim)[by_id]
                near = order(vecs, pivots, m)
                flat = near.ravel()
                post = np.argsort(flat, kind="stable")
                bounds = np.searchsorted(flat[post], np.arange(len(pivots) + 1)).astype(np.int32)
                row = [ids, vecs, bounds, (post // m).astype(np.int32), (post % m).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["ids", "vecs", "bounds", "rows", "ranks"])

    return vectors.mapInArrow(run, "ids binary, vecs binary, bounds binary, rows binary, ranks binary")


def _first_of_each(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """``order`` with each id's first place only."""
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)]


def _lookup(qids: np.ndarray, qvecs: np.ndarray, near: np.ndarray, m: int, k: int, share: float):
    def run(batches):
        dim = qvecs.shape[1]
        for batch in batches:
            for r in range(batch.num_rows):
                raw = [batch.column(c)[r].as_py() for c in range(5)]
                ids = np.frombuffer(raw[0], np.int64)
                vecs = np.frombuffer(raw[1], np.float64).reshape(-1, dim)
                bounds, rows, ranks = (np.frombuffer(x, np.int32) for x in raw[2:])
                n = len(ids)
                unique = bool((ids[1:] != ids[:-1]).all())
                best = min(n, max(EACH * k, int(np.ceil(share * n))))
                out = []
                for q in range(len(qids)):
                    saved = np.zeros(n, np.int32)
                    for rank, pivot in enumerate(near[q].tolist()):
                        a, b = bounds[pivot], bounds[pivot + 1]
                        saved[rows[a:b]] += footrule_saved(m, rank, ranks[a:b])
                    if best < n:
                        floor = np.partition(saved, n - best)[n - best]
                        sure = np.flatnonzero(saved > floor)
                        chosen = np.concatenate([sure, np.flatnonzero(saved == floor)[: best - len(sure)]])
                    else:
                        chosen = np.arange(n)
                    chosen = chosen[ids[chosen] != qids[q]]
                    d = np.sqrt(((vecs[chosen] - qvecs[q]) ** 2).sum(axis=1))
                    near_first = np.lexsort((ids[chosen], d))
                    top = near_first[:k] if unique else _first_of_each(ids[chosen], near_first)[:k]
                    out.append((np.full(len(top), qids[q]), ids[chosen[top]], d[top]))
                if out:
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["query_id", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, queries: Column, k: int = 10, pivots: int = PIVOTS, nearest: int = NEAREST, visited: int = VISITED, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``queries`` (over ``id``) holds, against every other row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for length in rows.select(F.size("vec").alias("d")).distinct().orderBy("d").collect():
        for part in _search(rows.where(F.size("vec") == length.d), length.d, queries, k, pivots, nearest, visited, share):
            found = found.unionByName(part)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, dim: int, queries: Column, k: int, pivots: int, nearest: int, visited: int, share: float):
    """(query_id, vec_id, score) of each block of queries, among vectors of one length."""
    asked = rows.where(queries).dropDuplicates(["id", "vec"])
    blocks = -(-asked.count() // QUERY_BLOCK)
    if not blocks:
        return
    chosen = rows.groupBy("vec").agg(F.min("id").alias("id")).orderBy(F.xxhash64("vec"), "id").limit(pivots).collect()
    base = np.array([r.vec for r in chosen], np.float64)
    m = min(nearest, len(base))
    same = Window.partitionBy("vec").orderBy("id")
    classes = rows.withColumn("nth", F.dense_rank().over(same)).where(F.col("nth") <= k + 1).select("id", "vec")
    index = keep(build(classes, base, m), "permutations")
    asked = keep(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    for b in range(blocks):
        block = asked.where(F.col("block") == b).orderBy("id").collect()
        qvecs = np.array([r.vec for r in block], np.float64).reshape(-1, dim)
        qids = np.array([r.id for r in block], np.int64)
        run = _lookup(qids, qvecs, order(qvecs, base, min(visited, m)), m, k, share)
        yield keep(index.mapInArrow(run, "query_id long, vec_id long, score double"), "neighbours")
    discard(index)
    discard(asked)
