"""Exact top-k search by inner product with an M-tree.

The greatest inner product is made the smallest distance: with M the greatest
norm, a vector x gets one more component sqrt(M*M - x.x) and a query q a zero, so
that their squared distance is q.q + M*M - 2 q.x.

The tree has three levels of pages. The root is a bounded sample of vectors
(routing objects); each vector goes to the nearest of them. A row of the index
is a subtree: vectors of one routing object that lie at similar distances from
it, its covering radius, and leaf pages of about PAGE vectors, each with its own
routing object, its radius, its distance to the parent, and the distances of its
entries to it.

A subtree is searched best first, many queries at once: every query takes its page
of least lower bound. First the bound is what the triangle inequality gives with the
stored distance to the parent; only a page that comes up with it has its own
distance computed, and an entry's inner product is computed only if its stored
distance to the page leaves a chance. Scores are exact integers; bounds are loosened by SLACK,
far above their rounding, so nothing is lost.

Queries go in blocks: one is on the driver and broadcast at a time, and what it
finds is written before the next. A block first visits only the subtrees of its
queries' own routing objects. The k-th scores found there are the thresholds with
which it visits the rest, most of whose subtrees and pages then fall away.

Of vectors that are equal only the k + 1 smallest ids are in the tree: no other
can be among k results, as ties go to smaller ids.

Defined results: components are floor(scale * x); vectors that are null or hold a
null or non-finite component take no part, nor do those with a component so large
that a score need not fit a long (the limit is :func:`largest`); zero and empty
vectors do take part; vectors of each length are a tree of their own; rows that
repeat id and vector count once; an id with several vectors counts by its best
score, as query and as candidate; a null id takes no part; an empty table, or one
without queries, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, keep

#: Most routing objects of the root, and vectors for each of them in a smaller table.
ROUTING, SHARE = 512, 1024
#: Most vectors of a subtree, and the usual number of a leaf page.
SUBTREE, PAGE = 4096, 64
QUERY_BLOCK = 4096
#: Share of the scale of distances by which bounds are loosened.
SLACK = 2e-6
#: Parts of the rows of one vector when its smallest ids are looked for.
SALT = 16

INDEX = "pivot int, radius double, ids binary, vecs binary, bounds binary, radii binary, parents binary, entries binary"
FOUND = "query_id long, vec_id long, score long"


def largest(length: int) -> int:
    """The largest component of which ``length`` products add up to a long."""
    return isqrt(((1 << 62) - 1) // max(length, 1))


def whole(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale))


def usable(vec: Column, scale: int) -> Column:
    limit = F.floor(F.sqrt(F.lit(2.0**61) / F.greatest(F.size(vec), F.lit(1))))
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < limit))


def lifted(vecs: np.ndarray, most: int) -> np.ndarray:
    """Data vectors with the component that makes all norms ``most``."""
    v = vecs.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(float(most) - (v * v).sum(axis=1), 0.0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; by floating point where that is exact too."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def centres(points: np.ndarray, n: int) -> np.ndarray:
    """n places far from one another, each the farthest from those before it."""
    chosen, far = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < n:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def subtree(ids: np.ndarray, vecs: np.ndarray, pivot: np.ndarray, most: int) -> list[bytes | float]:
    """Pages of some vectors below a routing object, as the columns of an index row after ``pivot``."""
    points = lifted(vecs, most)
    to_pivot = distances(points, pivot[None])[:, 0]
    near = distances(points, points[centres(points, -(-len(ids) // PAGE))]).argmin(axis=1)
    order = np.lexsort((to_pivot, near))
    near = near[order]
    # A page that grew over twice its size is cut along the distance to the routing object.
    _, firsts, sizes = np.unique(near, return_index=True, return_counts=True)
    starts = [at for first, n in zip(firsts.tolist(), sizes.tolist(), strict=True) for at in range(first, first + n, 2 * PAGE)]
    bounds = np.append(starts, len(ids)).astype(np.int32)
    radii, parents, entries = (np.zeros(n) for n in (len(starts), len(starts), len(ids)))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        # The page's routing object is its entry nearest to the middle.
        own = points[order[a:b]]
        first = int(distances(own, own.mean(axis=0)[None])[:, 0].argmin())
        order[[a, a + first]] = order[[a + first, a]]
        own[[0, first]] = own[[first, 0]]
        entries[a:b] = distances(own, own[:1])[:, 0]
        radii[k], parents[k] = entries[a:b].max(), to_pivot[order[a]]
    return [float(to_pivot.max()), *(x.tobytes() for x in (ids[order], vecs[order], bounds, radii, parents, entries))]


@dataclass
class Search:
    """A block of queries on its way through subtrees: the k best of each so far."""

    ids: np.ndarray
    vecs: np.ndarray
    floor: np.ndarray
    k: int
    most: int
    best: list[list[tuple[int, int]]] = field(default_factory=list)
    computed: int = 0

    def __post_init__(self) -> None:
        v = self.vecs.astype(np.float64)
        self.points = np.column_stack([v, np.zeros(len(v))])
        self.square = (v * v).sum(axis=1) + self.most
        self.slack = SLACK * (np.sqrt(self.square) + 1)
        self.floor = self.floor.copy()
        self.best = [[] for _ in self.ids]
        self.reach = self.within(np.arange(len(self.ids)))

    def within(self, q: np.ndarray) -> np.ndarray:
        """The distance that a vector must not exceed to score at least the floor."""
        known = self.floor[q] > np.iinfo(np.int64).min
        far = np.sqrt(np.maximum(self.square[q] - 2.0 * self.floor[q], 0.0))
        return np.where(known, far + self.slack[q], np.inf)

    def take(self, q: int, vec_id: int, score: int) -> None:
        best = self.best[q]
        for i, (s, v) in enumerate(best):
            if v == vec_id:
                if -s >= score:
                    return
                del best[i]
                break
        insort(best, (-score, vec_id))
        del best[self.k :]
        if len(best) == self.k and -best[-1][0] > self.floor[q]:
            self.floor[q] = -best[-1][0]

    def visit(self, pivot: np.ndarray, radius: float, ids: np.ndarray, vecs: np.ndarray, bounds: np.ndarray, radii: np.ndarray, parents: np.ndarray, entries: np.ndarray, asked: np.ndarray) -> None:
        """Search one subtree for the queries ``asked`` (places in the block)."""
        to_pivot = distances(self.points[asked], pivot[None])[:, 0]
        q = asked[to_pivot - radius <= self.reach[asked]]
        if not len(q):
            return
        to_pivot = distances(self.points[q], pivot[None])[:, 0]
        least = np.abs(to_pivot[:, None] - parents) - radii
        known = np.full(least.shape, np.nan)
        heads = lifted(vecs[bounds[:-1]], self.most)
        live = np.arange(len(q))
        while len(live):
            page = least[live].argmin(axis=1)
            there = (least[live, page] <= self.reach[q[live]]) & (least[live, page] < np.inf)
            live, page = live[there], page[there]
            for p in np.unique(page).tolist():
                rows = live[page == p]
                new = rows[np.isnan(known[rows, p])]
                if len(new):
                    known[new, p] = distances(self.points[q[new]], heads[p : p + 1])[:, 0]
                    self.computed += len(new)
                    least[new, p] = np.maximum(least[new, p], known[new, p] - radii[p])
                    # A query to which another page is nearer now takes that one first.
                    rows = rows[least[rows, p] <= np.minimum(self.reach[q[rows]], least[rows].min(axis=1))]
                if len(rows):
                    self.scan(q[rows], known[rows, p], ids, vecs, entries, slice(bounds[p], bounds[p + 1]))
                    least[rows, p] = np.inf

    def scan(self, q: np.ndarray, to_head: np.ndarray, ids: np.ndarray, vecs: np.ndarray, entries: np.ndarray, page: slice) -> None:
        chance = np.abs(to_head[:, None] - entries[page]) <= self.reach[q][:, None]
        some = np.flatnonzero(chance.any(axis=0))
        if not len(some):
            return
        self.computed += int(chance.sum())
        own = ids[page][some]
        scores = products(self.vecs[q], vecs[page][some])
        good = chance[:, some] & (scores >= self.floor[q][:, None]) & (own != self.ids[q][:, None])
        for r, c in zip(*np.nonzero(good), strict=True):
            self.take(int(q[r]), int(own[c]), int(scores[r, c]))
        changed = np.unique(np.nonzero(good)[0])
        self.reach[q[changed]] = self.within(q[changed])


def _lookup(search: tuple, roots: np.ndarray, home: np.ndarray, at_home: bool):
    def run(batches):
        s = Search(*search)
        dim = s.vecs.shape[1]
        kinds = (np.int64, np.int64, np.int32, np.float64, np.float64, np.float64)
        for batch in batches:
            for r in range(batch.num_rows):
                pivot = batch.column(0)[r].as_py()
                asked = np.flatnonzero((home == pivot) == at_home)
                if not len(asked):
                    continue
                ids, vecs, *rest = (np.frombuffer(batch.column(c)[r].as_py(), kind) for c, kind in enumerate(kinds, 2))
                s.visit(roots[pivot], batch.column(1)[r].as_py(), ids, vecs.reshape(len(ids), dim), *rest, asked)
        rows = [(int(s.ids[q]), v, -n) for q, best in enumerate(s.best) for n, v in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    return run


def build(vectors: DataFrame, dim: int, roots: np.ndarray, most: int) -> DataFrame:
    """The index as a table, from (id, vec): vectors go to their nearest routing object and are cut into subtrees by their distance to it."""
    flat = lambda column: np.asarray(column.flatten(), np.int64).reshape(len(column), dim)

    def assign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SUBTREE):
                part = batch.slice(at, SUBTREE)
                far = distances(lifted(flat(part.column(1)), most), roots)
                pivot = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(pivot)), pivot])], ["id", "vec", "pivot", "far"])

    def pages(batches):
        def send(ids, vecs, pivot):
            row = subtree(np.concatenate(ids), np.concatenate(vecs), roots[pivot], most)
            kinds = [pa.float64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([pivot], pa.int32()), *(pa.array([x], t) for x, t in zip(row, kinds, strict=True))], [c.split()[0] for c in INDEX.split(", ")])

        ids, vecs, n, last = [], [], 0, None
        for batch in batches:
            pivot = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(pivot) else []
            for a, b in zip(cuts, [*cuts[1:], len(pivot)], strict=True):
                for at in range(a, b, SUBTREE):
                    part = batch.slice(at, min(SUBTREE, b - at))
                    if n and (pivot[a] != last or n + part.num_rows > SUBTREE):
                        yield send(ids, vecs, last)
                        ids, vecs, n = [], [], 0
                    last = int(pivot[a])
                    ids.append(part.column(0).to_numpy())
                    vecs.append(flat(part.column(1)))
                    n += part.num_rows
        if n:
            yield send(ids, vecs, last)

    near = keep(vectors.mapInArrow(assign, "id long, vec array<long>, pivot int, far double"), "nearest")
    dealt = near.repartitionByRange("pivot", "far").sortWithinPartitions("pivot", "far", "id")
    index = keep(dealt.mapInArrow(pages, INDEX), "mtree")
    discard(near)
    return index


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """Of equal vectors the n smallest ids; a vector's many rows are first thinned in SALT parts."""
    thin = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    for by in (["vec", "salt"], ["vec"]):
        thin = thin.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("nth") <= n)
    return thin.select("id", "vec")


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``queries`` (over ``id``) holds, against every other row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec"), scale)).select("id", whole(F.col("vec"), scale).cast("array<long>").alias("vec"))
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for length in rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)).alias("most")).orderBy("d").collect():
        for part in _search(rows.where(F.size("vec") == length.d), length, queries, k, block):
            found = found.unionByName(part)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, length, queries: Column, k: int, block: int):
    """(query_id, vec_id, score) of each block of queries, among vectors of one length."""
    dim, most = length.d, length.most
    asked = rows.where(queries).distinct()
    blocks = -(-asked.count() // block)
    if not blocks:
        return
    classes = keep(smallest_ids(rows, k + 1), "vectors")
    first = classes.orderBy(F.xxhash64("vec"), "id").limit(min(ROUTING, -(-length.n // SHARE))).collect()
    as_array = lambda some: np.array([r.vec for r in some], np.int64).reshape(len(some), dim)
    roots = lifted(as_array(first), most)
    index = build(classes, dim, roots, most)
    discard(classes)
    asked = keep(asked.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks))), "queries")
    for b in range(blocks):
        some = asked.where(F.col("block") == b).orderBy("id", "vec").collect()
        if not some:
            continue
        qids, qvecs = np.array([r.id for r in some], np.int64), as_array(some)
        home = distances(np.column_stack([qvecs.astype(np.float64), np.zeros(len(some))]), roots).argmin(axis=1)
        floor = np.full(len(some), np.iinfo(np.int64).min)
        near = keep(index.mapInArrow(_lookup((qids, qvecs, floor, k, most), roots, home, True), FOUND), "neighbours")
        # What an id's k-th best has, over all its vectors, nothing below it can be among its results.
        best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        kth = {r.query_id: r.score for r in best.where(F.col("rank") == k).collect()}
        floor = np.array([kth.get(i, np.iinfo(np.int64).min) for i in qids.tolist()], np.int64)
        yield near
        yield keep(index.mapInArrow(_lookup((qids, qvecs, floor, k, most), roots, home, False), FOUND), "neighbours")
    discard(index)
    discard(asked)
