"""Runs of repeated words: Main and Lorentz's divide and conquer on interned words.

A document is halved again and again. At each midpoint, Z-functions say for
every period how far the words right of it and left of it go on equal to those a
period away; together they give every repetition that crosses the midpoint, in
time linear in the segment. A repetition that its segment cuts off is part of
one that a larger segment has found whole, so only those that end inside, or at
the text's own ends, are taken. Intervals found with several periods keep the
smallest.

A repetition of ``shortest`` words and ``times`` periods agrees with itself, one
period on, for at least 2 * ``gram`` words, so on one side of the midpoint the
Z-value is ``gram`` or more. All midpoints of a level, over many documents, are
first looked at together: only where the words next to the midpoint stand again
in its segment are Z-functions worth computing.

Documents are rows on their own: nothing is shuffled, and a task holds a chunk of
texts, or one text if it is longer.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; a null doc_id is answered like any other; repeated rows are
answered once each; of runs with the same exponent the one that starts first, then
the one with the smaller period is the best; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import PLAIN, Chunk, chunks, words

SHORTEST, TIMES = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(x: list[int]) -> list[int]:
    """For each place the length of the longest stretch there that x also begins with (0 for the first place)."""
    n, left, right = len(x), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def gram(shortest: int, times: int) -> int:
    """Words next to a midpoint that must stand again a period away, whatever the period."""
    return max(1, min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1)) // 2)


def crossing(x: np.ndarray, begin: int, mid: int, end: int, first: int, last: int, shortest: int, times: int) -> np.ndarray:
    """(start, end, period) of repetitions of x[begin:end] that meet ``mid``, in a text that is x[first:last]."""
    seg, m = x[begin:end].tolist(), mid - begin
    size, u, v = len(seg), seg[:m][::-1], seg[m:]
    ahead = np.array(z_function(v + [-1] + seg), np.int64)
    behind = np.array(z_function(u + [-1] + seg[::-1]), np.int64)
    q = np.arange(1, size - m, dtype=np.int64)  # compared with what stands q words on
    right = np.stack([mid - behind[m + 1 + (size - m) - q], mid + q + ahead[q], q])
    q = np.arange(1, m + 1, dtype=np.int64)  # and q words before
    back = np.concatenate([behind[:m], [0]])[q]
    left = np.stack([mid - q - back, mid + ahead[size - m + 1 + m - q], q])
    s, e, q = np.concatenate([right, left], axis=1)
    long = e - s >= np.maximum(shortest, times * q)
    s, e, q = s[long], e[long], q[long]
    cut = (s == begin) & (s > first) & (x[s - 1] == x[s - 1 + q])
    cut |= (e == end) & (e < last) & (x[np.minimum(e, len(x) - 1)] == x[e - q])
    return np.stack([s, e, q])[:, ~cut]


def runs_of(ids: np.ndarray, rows: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> np.ndarray:
    """(start, end, period) by start, then end, of all runs of texts ids[rows[i]:rows[i+1]]; places are those of ``ids``."""
    g, n = gram(shortest, times), len(ids)
    found = [np.zeros((3, 0), np.int64)]
    if n >= shortest:
        sums = np.zeros(n, np.uint64)
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        for k in range(g):  # the words from each place on; what runs past the end is no match that counts
            sums = sums * np.uint64(0xD1342543DE82EF95) + np.roll(spread, -k)
        first, last = rows[:-1].astype(np.int64), rows[1:].astype(np.int64)
        begin, end = first, last
        while True:
            fits = end - begin >= shortest
            begin, end, first, last = begin[fits], end[fits], first[fits], last[fits]
            if not len(begin):
                break
            mid = (begin + end) // 2
            for i in again(sums, begin, mid, end, g).tolist():
                found.append(crossing(ids, *(int(a[i]) for a in (begin, mid, end, first, last)), shortest, times))
            begin, end, first, last = np.concatenate([begin, mid]), np.concatenate([mid, end]), np.tile(first, 2), np.tile(last, 2)
    s, e, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return np.stack([s, e, q])[:, new]


def again(sums: np.ndarray, begin: np.ndarray, mid: np.ndarray, end: np.ndarray, g: int) -> np.ndarray:
    """Segments in which the g words from the midpoint on, or those before it, stand at another place too."""
    sizes = end - begin
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) - np.repeat(ends - sizes - begin, sizes)
    own = sums[at]
    hits = (own == np.repeat(sums[mid], sizes)) | (own == np.repeat(sums[np.maximum(mid - g, 0)], sizes))
    # The midpoint itself and the g words before it always match.
    return np.flatnonzero(np.add.reduceat(hits, ends - sizes, dtype=np.int64) > 2 - (mid - g < begin) - (sums[mid] == sums[np.maximum(mid - g, 0)]))


def joined(chunk: Chunk, start: np.ndarray, end: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, one space between them."""
    step = np.zeros(len(chunk.data) + 2, np.int32)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[keep]
    start, end = start[keep], end[keep]
    more = np.append(row[1:] == row[:-1], False)[: len(row)]  # another word of the row follows
    np.add.at(step, start, 1)
    np.add.at(step, end + more, -1)
    out = chunk.data.copy()
    out[end[more]] = 0x20
    inside = np.cumsum(step[: len(out)]) > 0
    offsets = np.concatenate([[0], np.cumsum(inside)])[chunk.offsets]
    return pa.LargeStringArray.from_buffers(chunk.rows, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[inside].tobytes())).cast(pa.string())


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Of (start, length, period), the one with the greatest exact length / period."""
    top = None
    for r in runs:
        if top is None or (r[1] * top[2], -r[0], -r[2]) > (top[1] * r[2], -top[0], -top[2]):
            top = r
    return top


def find(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), best, and the text with every run cut to its first period."""
    if times < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                w = words(c, PLAIN)
                ids = np.unique(w.hash, return_inverse=True)[1].astype(np.int64)
                s, e, q = runs_of(ids, w.rows, shortest, times)
                drop = np.zeros(len(ids) + 1, np.int64)
                np.add.at(drop, s + q, 1)
                np.add.at(drop, e, -1)
                keep = np.cumsum(drop[:-1]) == 0
                of = np.searchsorted(w.rows, s, "right") - 1
                by_row: list[list[tuple[int, int, int]]] = [[] for _ in range(c.rows)]
                for d, a, b, p in zip(of.tolist(), (s - w.rows[of]).tolist(), (e - s).tolist(), q.tolist(), strict=True):
                    by_row[d].append((a, b, p))
                named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(c.first, c.rows),
                        pa.array(np.diff(w.rows).astype(np.int64)),
                        pa.array([[named(r) for r in sorted(rows, key=lambda r: (r[0], r[2]))] for rows in by_row], pa.list_(RUN)),
                        pa.array([named(best(rows)) for rows in by_row], RUN),
                        joined(c, w.start, w.end, w.rows, keep),
                    ],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, best struct<start:long,length:long,period:long>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which one document in ten, by the CRC-32 of its id, goes on with a stretch of its own words over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def again(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))), " ")

    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w))), F.lit(0))
    return F.coalesce(F.when(h % 10 == 0, made), text)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run and its exponent, and digests of all runs and of the collapsed text."""
    found = find(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
