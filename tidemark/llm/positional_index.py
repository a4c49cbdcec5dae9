"""Benchmark decontamination with a positional inverted index.

The index is a table. A row is a shard, some documents with about SHARD words:
the terms that stand in it, sorted, and for each the sorted places where it
stands. It is written once, for all words, whatever the tests are.

A test window starts from its rarest term's list in a shard and is intersected
with the other terms' lists, each shifted by its offset; what is left after the
last term are exact phrase matches. In the same pass, proximity matches are the
places of a window's first term that have all its other terms within a span of words,
narrowed from the rarest of them on.

Tests are taken in blocks of a bounded number of bytes. One block at a time is
on the driver and broadcast; with several, what a block hits is written before
the next, and the hits are merged by document.

Defined results: a null or empty text has no words and no hits; a test without
words has no window; a test whose id is null is left out, as it cannot be
named; repeated tests count once per id; repeated document rows are answered
once each; an empty table of tests leaves every document clean, an empty
corpus gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, chunks, lists, words, words_of
from .scratch import keep

WINDOW = 10
#: Bytes of test text that are broadcast at once.
BLOCK_BYTES = 4 << 20

#: Words of a shard, but that a document is in one shard.
SHARD = 1 << 20

INDEX = "ids array<long>, ths array<long>, n_words binary, terms binary, bounds binary, places binary"
HITS = "doc_id long, _tm_th long, n_words long, hits array<int>, items array<string>, near array<int>, near_items array<string>"
#: Words within which all terms of a window must stand for a proximity match.
SPAN = 20


@dataclass
class Tests:
    """Distinct windows of one block of tests, by length, and the items that hold each."""

    terms: np.ndarray
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]


def windows_of(items: list[tuple[str, str]], width: int) -> Tests:
    hashed = [(item, words_of(text or "", ALNUM)) for item, text in items]
    terms = np.unique(np.concatenate([h for _, h in hashed] or [np.zeros(0, np.uint64)]))
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, h in hashed:
        if not len(h):
            continue
        ids = np.searchsorted(terms, h).astype(np.int32)
        n = min(width, len(ids))
        for i in range(len(ids) - n + 1):
            found.setdefault(n, {}).setdefault(ids[i : i + n].tobytes(), set()).add(item)
    return Tests(
        terms,
        {n: np.frombuffer(b"".join(w), np.int32).reshape(-1, n) for n, w in found.items()},
        {n: [sorted(x) for x in w.values()] for n, w in found.items()},
    )


class Shard:
    """Positional inverted lists of some documents. A place is the number of a word in the shard."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, bounds: np.ndarray, places: np.ndarray):
        self.n_words, self.terms, self.bounds, self.places = n_words, terms, bounds, places
        self.first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)

    @classmethod
    def of(cls, found: list[Words]) -> Shard:
        n_words = np.concatenate([np.diff(w.rows) for w in found] or [np.zeros(0, np.int64)])
        h = np.concatenate([w.hash for w in found] or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return cls(n_words, h[new], np.append(new, len(h)), order)

    def row(self) -> list[bytes]:
        return [x.astype(t).tobytes() for x, t in ((self.n_words, "<i4"), (self.terms, "<u8"), (self.bounds, "<i4"), (self.places, "<i4"))]

    @classmethod
    def from_row(cls, raw: list[bytes]) -> Shard:
        n_words, terms, bounds, places = (np.frombuffer(x, t) for x, t in zip(raw, ("<i4", "<u8", "<i4", "<i4"), strict=True))
        return cls(n_words.astype(np.int64), terms, bounds.astype(np.int64), places)

    def ask(self, terms: np.ndarray) -> None:
        """Look up the terms of a block of tests; from here on a term is its number there."""
        k = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        there = self.terms[k] == terms if len(self.terms) else np.zeros(len(terms), bool)
        self.at = np.where(there, k, -1)
        self.lengths = np.where(there, np.diff(self.bounds)[k] if len(self.terms) else 0, 0)

    def postings(self, term: int) -> np.ndarray:
        k = self.at[term]
        return self.places[self.bounds[k] : self.bounds[k + 1]].astype(np.int64) if k >= 0 else np.zeros(0, np.int64)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Places where the window's terms stand one after the other in one document."""
        starts = None
        for k in np.argsort(self.lengths[window], kind="stable"):
            shifted = self.postings(window[k]) - k
            starts = shifted if starts is None else starts[_in_sorted(starts, shifted)]
            if not len(starts):
                return starts
        last = starts + len(window) - 1
        return starts[(starts >= 0) & (self.document(np.maximum(starts, 0)) == self.document(last))]

    def near(self, window: np.ndarray, span: int) -> np.ndarray:
        """Places of the window's first term that have every other term within ``span`` words in their document; the rarest is looked for first."""
        others = np.unique(window)
        others = others[others != window[0]]
        places = self.postings(window[0])
        for term in others[np.argsort(self.lengths[others], kind="stable")]:
            other = self.postings(term)
            if not len(other) or not len(places):
                return places[:0]
            if len(other) < len(places):  # marked from the shorter list: each of its places makes a stretch good
                doc = self.document(other)
                lo = np.searchsorted(places, np.maximum(other - span, self.first[doc]))
                hi = np.searchsorted(places, np.minimum(other + span, self.first[doc + 1] - 1), "right")
                marks = np.bincount(lo, minlength=len(places) + 1) - np.bincount(hi, minlength=len(places) + 1)
                places = places[np.cumsum(marks[:-1]) > 0]
            else:
                k = np.searchsorted(other, places)
                left, right = other[np.maximum(k - 1, 0)], other[np.minimum(k, len(other) - 1)]
                doc = self.document(places)
                close = [(abs(o - places) <= span) & (self.document(o) == doc) for o in (left, right)]
                places = places[close[0] | close[1]]
        return places


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table in the shared folder. ``ths`` are hashes of the texts, which tell rows of one id apart."""

    def run(batches):
        def send(held):
            ids, ths, found = zip(*held, strict=True)
            ids, ths = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(ths).combine_chunks()
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, ths)]
            return pa.RecordBatch.from_arrays([*one, *(pa.array([x], pa.binary()) for x in Shard.of(list(found)).row())], ["ids", "ths", "n_words", "terms", "bounds", "places"])

        held, n = [], 0
        for batch in batches:
            for c in chunks(batch.column(2)):
                w = words(c, ALNUM)
                if held and n + len(w.hash) > SHARD:
                    yield send(held)
                    held, n = [], 0
                held.append((batch.column(0).slice(c.first, c.rows), batch.column(1).slice(c.first, c.rows), w))
                n += len(w.hash)
        if held:
            yield send(held)

    text = F.col(text_col).cast("string")
    return keep(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, INDEX), "postings")


def _search(tests: Tests, span: int | None, hits_only: bool, near: int | None = None):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard.from_row([batch.column(c)[r].as_py() for c in range(2, 6)])
                shard.ask(tests.terms)
                rows = len(shard.n_words)
                found = [([np.zeros(0, np.int64)], set()) for _ in range(2)]
                for n, windows in tests.windows.items():
                    for k in np.flatnonzero(shard.lengths[windows].min(axis=1) > 0):
                        first = shard.phrase(windows[k]) if span is None else shard.near(windows[k], span)
                        close = first[:0] if near is None else shard.near(windows[k], near)
                        for (places, pairs), starts, width in zip(found, (first, close), (n if span is None else 1, 1), strict=True):
                            if len(starts):
                                places.append((starts[:, None] + np.arange(width)).ravel())
                                pairs.update((d, item) for d in np.unique(shard.document(starts)).tolist() for item in tests.items[n][k])
                columns, any_hit = [], []
                for places, pairs in found:
                    hit = np.unique(np.concatenate(places))
                    doc = shard.document(hit)
                    by_doc: list[list[str]] = [[] for _ in range(rows)]
                    for d, item in sorted(pairs):
                        by_doc[d].append(item)
                    columns += [lists(hit - shard.first[doc], np.bincount(doc, minlength=rows), pa.int32()), pa.array(by_doc, pa.list_(pa.string()))]
                    any_hit.append(doc)
                out = pa.RecordBatch.from_arrays([batch.column(0)[r].values, batch.column(1)[r].values, pa.array(shard.n_words, pa.int64()), *columns], ["doc_id", "_tm_th", "n_words", "hits", "items", "near", "near_items"])
                yield out.take(pa.array(np.unique(np.concatenate(any_hit)))) if hits_only else out

    return run


def search(docs: DataFrame, tests: DataFrame, width: int = WINDOW, span: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, near: int | None = None) -> DataFrame:
    """One row per document: n_words, ``hits``, the places that a test phrase covers, and ``items``, the ids of the tests.

    With ``span`` these are proximity matches instead: places of a window's first
    term that have all its other terms within that many words, in any order. With
    ``near`` those within so many words are given as well, in ``near`` and ``near_items``.
    """
    return look_up(build(docs, id_col, text_col), tests, width, span, block_bytes, near)


def look_up(index: DataFrame, tests: DataFrame, width: int = WINDOW, span: int | None = None, block_bytes: int = BLOCK_BYTES, near: int | None = None) -> DataFrame:
    """As ``search``, in a table of ``build``."""
    tests = tests.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("t")).where("item is not null")
    total = tests.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    read = lambda df: windows_of(sorted((r.item, r.t or "") for r in df.collect()), width)
    if blocks == 1:
        return index.mapInArrow(_search(read(tests), span, False, near), HITS).drop("_tm_th")
    every = index.mapInArrow(_search(windows_of([], width), span, False, near), HITS).withColumn("_tm_rows", F.lit(1))
    for b in range(blocks):
        block = read(tests.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b))
        every = every.unionByName(keep(index.mapInArrow(_search(block, span, True, near), HITS), "hits").withColumn("_tm_rows", F.lit(0)))
    joined = every.groupBy("doc_id", "_tm_th").agg(
        F.max("n_words").alias("n_words"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "items", "near", "near_items")],
        F.sum("_tm_rows").cast("int").alias("_tm_rows"),
    )
    again = F.explode(F.sequence(F.lit(1), F.col("_tm_rows")))
    return joined.withColumn("_tm_nth", again).drop("_tm_th", "_tm_rows", "_tm_nth")


def contamination(docs: DataFrame, tests: DataFrame, width: int = WINDOW, near: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``near`` also n_near and n_near_items."""
    found = search(docs, tests, width, near=near)
    close = [F.size("near").cast("long").alias("n_near"), F.size("near_items").cast("long").alias("n_near_items")]
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        *(close if near is not None else []),
    )
