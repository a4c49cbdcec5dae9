"""The most frequent keys of a count table, and a filter of the keys of a table, both of a bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the logarithm of a count that are told apart; counts under 90 are told apart exactly.
STEPS = 64
#: Bits of a bucket of a filter.
BUCKET = 1 << 15
#: Most keys that a join broadcasts.
HOT = 1024


def frequent(counts: DataFrame, n: str, most: int) -> tuple[DataFrame, float]:
    """(rows of ``counts`` that are among its ``most`` most frequent, the step from which rows are taken).

    Rows are taken by whole steps of the logarithm of their count, so no task
    sorts or holds all of them; rows of a step that doesn't fit stay out.
    """
    sizes = counts.groupBy(step(n).alias("s")).count().collect()
    least, room = float("inf"), most
    for r in sorted(sizes, key=lambda r: -r.s):
        room -= r["count"]
        if room < 0:
            break
        least = r.s
    return counts.where(step(n) >= least), least


def step(n: str):
    return F.floor(F.log2(F.col(n)) * STEPS)


def unique_sums(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands (or the sums of its weights)."""
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def tallies(key: np.ndarray, n: np.ndarray, names: tuple[str, str]):
    """Arrow batches of (key, n) of a bounded size."""
    for at in range(0, len(key), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(key[part].astype(np.int64, copy=False)), pa.array(n[part].astype(np.int64, copy=False))], list(names))


def filter_bits(n: int, least: int = 20, most: int = 28) -> int:
    """Size of a filter of n keys: eight bits a key, between bounds (2**28 are 32 MB)."""
    return (1 << min(max((8 * max(n, 1) - 1).bit_length(), least), most)) - 1


def key_filter(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """Bitmap of ``key`` modulo ``bits``. A key that is not there may pass it; one that is there always does."""
    at = F.pmod(F.col(key), F.lit(bits))
    # Dealt by bucket first: else every task would send a bitmap of its own.
    dealt = keys.select(F.floor(at / BUCKET).cast("int").alias("b"), (at % BUCKET).alias("p")).repartition("b")
    made = dealt.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros((bits // BUCKET + 1) * BUCKET // 8, np.uint8)
    for r in made.toLocalIterator():
        out[r.b * (BUCKET // 8) : (r.b + 1) * (BUCKET // 8)] = np.frombuffer(r.m, np.uint8)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    at = keys % bits
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and says in ``n`` how many of ``rows`` have it.

    Keys that a HOT-th of all rows or more have, of which there are at most HOT, are broadcast; their rows aren't shuffled.
    """
    least = F.lit(max(rows.count() / HOT, 1.0))
    hot, rest = F.broadcast(table.where(F.col(n) >= least).drop(n)), table.where(F.col(n) < least).drop(n)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys)
    return rows.join(hot, keys).unionByName(cold)
