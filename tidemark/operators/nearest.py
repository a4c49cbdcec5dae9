"""Exact nearest texts of an account among the protected user's posts.

The user's side is bounded by the number of posts sampled (50 by default). Its
size is checked before it is broadcast as one matrix; beyond that, the targets
are dealt into parts of bounded size, mine go to each part by a shuffle, and a
task holds the targets of its part and reads mine in order, a block at a time.
No table is joined, so none can be broadcast, and nothing is collected then. All
pairs are compared: the work grows with the product of both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine, mean_vector

MOST = 500
#: Rows of a product of two matrices.
BLOCK = 2048
#: Numbers of the targets that a task holds; parts that few targets are dealt over.
HELD, LEAST_PARTS = 1 << 21, 32


def best_match(targets: DataFrame, mine: DataFrame, most: int = MOST, block: int | None = None) -> DataFrame:
    """target_id, mine_id, similarity: the last of equally near posts of mine. targets: target_id, a; mine: mine_id, b.

    Null, empty, zero or differently long vectors have similarity 0.
    """
    kind = dict(targets.dtypes)["target_id"]
    out = f"target_id {kind}, mine_id {dict(mine.dtypes)['mine_id']}, similarity double"
    rows = mine.select("mine_id", F.col("b").cast("array<double>").alias("b"))
    head = rows.limit(most + 1).collect()
    if not head:
        return targets.select("target_id", mine_none(mine), F.lit(0.0).alias("similarity")).where("false")
    if len(head) <= most:
        head = sorted(head, key=lambda r: r.mine_id, reverse=True)
        return targets.select("target_id", F.col("a").cast("array<double>").alias("a")).mapInArrow(_best(head, to_arrow_type(mine.schema["mine_id"].dataType)), out)
    return _by_blocks(targets, rows, block, out)


def _by_blocks(targets: DataFrame, mine: DataFrame, block: int | None, out: str) -> DataFrame:
    theirs = targets.select("target_id", F.col("a").cast("array<double>").alias("a"))
    n, dim = theirs.agg(F.count("*"), F.coalesce(F.max(F.size("a")), F.lit(1))).first()
    # Few rows are dealt over more parts than they would fill, as a part is one task.
    parts = max(1, -(-n // (block or max(1, HELD // max(1, dim)))), min(LEAST_PARTS, -(-n // BLOCK)))
    same = {f.name: f.dataType.simpleString() for f in (*theirs.schema.fields, *mine.schema.fields)}
    none = lambda c: F.lit(None).cast(same[c]).alias(c)
    left = theirs.select(F.pmod(F.xxhash64("target_id", "a"), F.lit(parts)).cast("int").alias("part"), F.size("a").alias("dim"), "target_id", none("mine_id"), F.col("a").alias("v"))
    right = mine.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.size("b").alias("dim"), none("target_id"), "mine_id", F.col("b").alias("v"))
    rows = left.unionByName(right.where("mine_id is not null")).where("dim > 0").withColumn("own", F.col("mine_id").isNotNull())
    # In a part: its targets, then all of mine by id, for one length of vectors after the other.
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "dim", "own", "mine_id")
    pairs = dealt.mapInArrow(_best_of_parts, out)
    # Whoever has no direction, or no vector of mine of its length, is as near to the last of mine as to any.
    nobody = theirs.select("target_id").distinct().crossJoin(F.broadcast(mine.agg(F.max("mine_id").alias("mine_id")))).select("target_id", "mine_id", F.lit(0.0).alias("similarity"))
    best = pairs.unionByName(nobody).groupBy("target_id").agg(F.max(F.struct("similarity", "mine_id")).alias("m"))
    return best.select("target_id", "m.mine_id", "m.similarity")


def _units(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    m = np.nan_to_num(np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64)).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Part:
    """Targets of one part and length, and the best of mine so far."""

    def __init__(self, dim: int):
        self.dim, self.ids, self.vecs, self.best, self.mine = dim, [], [], None, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch.column("target_id"))
        self.vecs.append(_units(batch, self.dim))

    def meet(self, batch: pa.RecordBatch) -> None:
        """Mine, by id. Single precision tells whose best can change; those are worked out in double."""
        if not self.ids:
            return
        if self.best is None:
            self.x = np.concatenate(self.vecs)
            self.small, self.vecs = self.x.astype(np.float32), []
            self.best, self.at = np.full(len(self.x), -1.0), np.zeros(len(self.x), np.int64)
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            y = _units(part, self.dim)[::-1]
            small, changed, last = y.astype(np.float32), False, len(self.mine)
            for lo in range(0, len(self.x), BLOCK):
                hi = min(lo + BLOCK, len(self.x))
                most = np.maximum((self.small[lo:hi] @ small.T).max(axis=1), 0)
                row = lo + np.flatnonzero(most + 4e-7 * (self.dim + 8) >= self.best[lo:hi])
                if not len(row):
                    continue
                # Rounded, so that equal vectors tie whatever order their sums are taken in; the last of equals stays.
                near = np.clip(self.x[row] @ y.T, 0, 1).round(12)
                first = near.argmax(axis=1)
                value = near[np.arange(len(row)), first]
                up = value >= self.best[row]
                self.best[row[up]], self.at[row[up]] = value[up], last * BLOCK + len(y) - 1 - first[up]
                changed = changed or bool(up.any())
            if changed:
                self.mine.append(part.column("mine_id").take(pa.array(np.arange(len(y)))))  # a copy, that the batch can go
                self._forget()

    def _forget(self) -> None:
        """Once there are many blocks of ids, only those of best ones stay."""
        if len(self.mine) * BLOCK > 4 * max(len(self.x), BLOCK):
            self.mine, self.at = self._chosen(), None
            self.mine = [self.mine.slice(k, BLOCK) for k in range(0, len(self.mine), BLOCK)]
            self.at = np.arange(len(self.x))

    def _chosen(self) -> pa.Array:
        begin = np.cumsum([0, *map(len, self.mine)])
        return pa.concat_arrays(self.mine).take(pa.array(begin[self.at // BLOCK] + self.at % BLOCK))

    def done(self):
        if self.best is not None and self.mine:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(self.ids), self._chosen(), pa.array(self.best)], ["target_id", "mine_id", "similarity"])


def _best_of_parts(batches):
    held, key = None, None
    for b in batches:
        marks = [b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "dim", "own")]
        cuts = np.flatnonzero(np.append(True, np.any([m[1:] != m[:-1] for m in marks], axis=0))).tolist() if b.num_rows else []
        for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
            if (now := (int(marks[0][lo]), int(marks[1][lo]))) != key:
                if held:
                    yield from held.done()
                held, key = _Part(now[1]), now
            (held.meet if marks[2][lo] else held.add)(b.slice(lo, hi - lo))
    if held:
        yield from held.done()


def mine_none(mine: DataFrame):
    return F.lit(None).cast(dict(mine.dtypes)["mine_id"]).alias("mine_id")


def _unit(vecs: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors by length."""
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vecs):
        if v is not None and len(v):
            by_length.setdefault(len(v), []).append(i)
    out = {}
    for n, at in by_length.items():
        m = np.nan_to_num(np.array([vecs[i] for i in at], np.float64))
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[n] = np.array(at), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return out


def _best(rows: list, kind: pa.DataType):
    ids, mine = [r.mine_id for r in rows], _unit([r.b for r in rows])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = np.zeros((part.num_rows, len(ids)))
                for n, (i, m) in _unit(part.column(1).to_pylist()).items():
                    if n in mine:
                        j, other = mine[n]
                        near[np.ix_(i, j)] = m @ other.T
                # Rounded, so that equal vectors tie whatever order their sums are taken in.
                near = np.clip(near, 0, 1).round(12)
                first = near.argmax(axis=1)
                chosen = pa.array([ids[k] for k in first.tolist()], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), chosen, pa.array(near[np.arange(len(first)), first])], ["target_id", "mine_id", "similarity"])

    return run


def top_by_mean(targets: DataFrame, mine: DataFrame, n: int = 3, key: str = "account_id") -> DataFrame:
    """The n targets of each account nearest to the mean of mine; ties to the smaller id. targets: key, target_id, a."""
    mean = mean_vector(mine, "b").select("mean")
    scored = targets.crossJoin(F.broadcast(mean)).select(*targets.columns, cosine(F.col("a"), F.col("mean")).alias("similarity"))
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), "target_id")
    return scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def nearest_to_mean(targets: DataFrame, mine: DataFrame, n: int = 3) -> DataFrame:
    """The n targets nearest to the mean of mine; ties to the smaller id."""
    mean = mean_vector(mine, "b").select("mean")
    scored = targets.crossJoin(F.broadcast(mean)).select("target_id", cosine(F.col("a"), F.col("mean")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "target_id").limit(n)
