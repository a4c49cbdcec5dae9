"""Substring deduplication by relative Lempel-Ziv parsing.

The reference of a document are all documents with a smaller doc_id. It is cut
into blocks by content: a window of WINDOW words has an anchor, the ANCHOR-word
gram of smallest hash in it, and a run of windows with one anchor is a block.
Equal text is cut alike wherever it stands, so every block of the reference is
in an index by hash, with the smallest document that holds it and its place.

A document is factored greedily against it: a factor starts at a block found in
the index and goes on as long as the next blocks are found where the source
goes on. Where a block itself isn't found, a factor may still begin or end
inside it; there, at factor boundaries, each window is looked up by itself and
lengthens the factor. Factors, of WINDOW words at least, are copies of their
source (document and first word) and become the duplicate spans; the words in
them go.

Passes over the texts: (1) which anchors stand in two documents at least; (2)
blocks of those; (3) windows of blocks whose anchor has different blocks; (4)
cutting the text. Before it sends blocks, a task settles what it can see: of
the documents that share a block only its smallest is sent on, with all places
it stands at, as for the others a smaller one is known. So a passage in a third
of all documents costs the index the entries of one document a task. The index
is sorted by Spark and read in order; no group is held in memory. Anchors that
pass on are known by a bitmap of eight bits an anchor, 128 MB at most; a full
bitmap would only cost work, not results.

Hashes of blocks and windows have 128 bits.

Defined results: a null, empty or blank text has no words; a document of fewer
than WINDOW words loses none; rows without doc_id are left out, as they cannot
be named; rows that repeat doc_id and text are answered once each and are no
copies of one another; an id should name one text: rows that repeat an id with
other texts all lose the spans found for the id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import PLAIN, chunks, mixed, words
from .frequent import BUCKET, filter_bits, passes
from .scratch import discard, keep, release

WINDOW = 13
ANCHOR = 5
#: Bytes of text for one anchor, about.
ANCHOR_BYTES = 32
#: Blocks or windows that a task holds before it settles and sends them.
HELD = 1 << 20

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPAN = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("doc", "<i8"), ("pos", "<i8")])
#: Rows of a pass. ENTRY: hash of a block, its document and place. FOUND: source document and word, document and place.
#: ANCHORS: anchor, smallest and largest value. A place is the first window's word and the number of windows in four bits.
OUT = "kind int, h1 long, h2 long, doc long, pos long"
FOUND, ENTRY, ANCHORS = 0, 1, 2


class Parsed:
    """Blocks of a chunk: first window (``lo``, a word number in the chunk), windows, anchor and row."""

    def __init__(self, chunk, window: int, anchor: int):
        w = words(chunk, PLAIN)
        self.words, self.hash = w, w.hash
        n = len(self.hash) - window + 1
        self.row = w.row_of()
        none = np.zeros(0, np.int64)
        self.lo, self.cnt, self.anchor = none, none, np.zeros(0, np.uint64)
        if n <= 0:
            return
        valid = np.flatnonzero(self.row[:n] == self.row[window - 1 :])
        if not len(valid):
            return
        gram = self.hash[: len(self.hash) - anchor + 1].copy()
        for j in range(1, anchor):
            gram *= M1
            gram += self.hash[j : j + len(gram)]
        gram = mixed(gram)
        best, at = gram[:n].copy(), np.zeros(n, np.int8)
        for j in range(1, window - anchor + 1):
            less = gram[j : j + n] < best
            best[less] = gram[j : j + n][less]
            at[less] = j
        where = valid + at[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (where[1:] != where[:-1]) | (np.diff(valid) != 1)
        first = np.flatnonzero(new)
        self.lo = valid[first]
        self.cnt = np.diff(np.append(first, len(valid)))
        self.anchor = gram[where[first]]

    def block_hashes(self, pick: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for the words that the picked blocks cover."""
        lo, size = self.lo[pick], self.cnt[pick] + window - 1
        out = []
        for m in (M1, M2):
            h = size.astype(np.uint64)
            for j in range(int(size.max()) if len(size) else 0):
                more = size > j
                h = np.where(more, h * m + self.hash[np.minimum(lo + j, len(self.hash) - 1)], h)
            out.append(mixed(h))
        return out[0], out[1]

    def window_hashes(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for m in (M1, M2):
            h = np.zeros(len(at), np.uint64)
            for j in range(window):
                h = h * m + self.hash[at + j]
            out.append(mixed(h))
        return out[0], out[1]


def _rows(kind: int, *columns: np.ndarray):
    """Arrow batches of one kind; columns that are not given are 0."""
    n = len(columns[0])
    for at in range(0, n, 1 << 16):
        part = [np.asarray(c[at : at + (1 << 16)]).astype(np.int64, copy=False) for c in columns]
        part += [np.zeros(len(part[0]), np.int64)] * (4 - len(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *map(pa.array, part)], ["kind", "h1", "h2", "doc", "pos"])


def settle(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all spans of the smallest document of each hash, spans of other documents, source document and word of those).

    All, since where another task has a smaller document, each place that the words stand in here is a copy of it.
    """
    spans = spans[np.lexsort((spans["pos"], spans["doc"], spans["h2"], spans["h1"]))]
    new = np.ones(len(spans), bool)
    new[1:] = (spans["h1"][1:] != spans["h1"][:-1]) | (spans["h2"][1:] != spans["h2"][:-1])
    source = spans[new][np.cumsum(new) - 1] if len(spans) else spans
    other = spans["doc"] != source["doc"]
    return spans[~other], spans[other], source["doc"][other], source["pos"][other] >> 4


def _spread(key: np.ndarray, value: np.ndarray):
    """Smallest and largest value of each key, as rows."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    yield from _rows(ANCHORS, key[first], value[first], value[last])


def _several(rows: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the anchors whose values differ. One shuffle, by segment of the bitmap."""
    at = F.pmod(F.col("h1"), F.lit(bits))
    rows = rows.where(F.col("kind") == ANCHORS).select(F.floor(at / BUCKET).cast("int").alias("b"), F.col("h1").alias("g"), F.col("h2").alias("lo"), F.col("doc").alias("hi"))
    differ = rows.repartition("b").groupBy("b", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    made = differ.groupBy("b").agg(F.bitmap_construct_agg(F.pmod(F.col("g"), F.lit(bits)) % BUCKET).alias("m"))
    out = np.zeros((bits // BUCKET + 1) * BUCKET // 8, np.uint8)
    for r in made.toLocalIterator():
        out[r.b * (BUCKET // 8) : (r.b + 1) * (BUCKET // 8)] = np.frombuffer(r.m, np.uint8)
    return out


def _doc_ids(batch, chunk) -> np.ndarray:
    return np.asarray(batch.column(0))[chunk.first : chunk.first + chunk.rows]


def _find_anchors(window: int, anchor: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                p = Parsed(c, window, anchor)
                held.append((p.anchor.view(np.int64), _doc_ids(batch, c)[p.row[p.lo]]))
                n += len(p.anchor)
            if n > HELD:
                yield from _spread(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from _spread(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _find(window: int, anchor: int, bits: int, shared, blocks: bool):
    """Blocks (or each of their windows) whose anchor passes the bitmap: settled, and the hashes of an anchor's blocks."""

    def send(held, anchors):
        mine, others, source, at = settle(np.concatenate(held))
        yield from _rows(FOUND, source, at, others["doc"], others["pos"])
        yield from _rows(ENTRY, mine["h1"], mine["h2"], mine["doc"], mine["pos"])
        if blocks:
            yield from _spread(*map(np.concatenate, zip(*anchors, strict=True)))

    def run(batches):
        held, anchors, n = [], [], 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                p = Parsed(c, window, anchor)
                pick = np.flatnonzero(passes(shared.value, p.anchor.view(np.int64), bits))
                if not len(pick):
                    continue
                at, cnt = p.lo[pick], p.cnt[pick]
                if blocks:
                    h1, h2 = p.block_hashes(pick, window)
                    anchors.append((p.anchor[pick].view(np.int64), h1.view(np.int64)))
                else:
                    at = np.repeat(at - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) + np.arange(cnt.sum())
                    cnt = np.ones(len(at), np.int64)
                    h1, h2 = p.window_hashes(at, window)
                e, row = np.empty(len(at), SPAN), p.row[at]
                e["h1"], e["h2"] = h1.view(np.int64), h2.view(np.int64)
                e["doc"], e["pos"] = _doc_ids(batch, c)[row], (at - p.words.rows[row]) << 4 | cnt
                held.append(e)
                n += len(e)
            if n > HELD:
                yield from send(held, anchors)
                held, anchors, n = [], [], 0
        if n:
            yield from send(held, anchors)

    return run


def located(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, pos, source, at), in a kept table: blocks and windows that a smaller document has too, and where. docs: doc_id, text."""
    if window - anchor + 1 > 15:
        raise ValueError("a block has at most 15 windows")
    sc = docs.sparkSession.sparkContext
    bits = filter_bits((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ANCHOR_BYTES, most=30)
    shared = sc.broadcast(_several(docs.mapInArrow(_find_anchors(window, anchor), OUT), bits))
    release(docs.sparkSession)
    blocks = keep(docs.mapInArrow(_find(window, anchor, bits, shared, True), OUT), "blocks")
    shared = sc.broadcast(_several(blocks, bits))
    release(docs.sparkSession)
    windows = keep(docs.mapInArrow(_find(window, anchor, bits, shared, False), OUT), "windows")
    same = Window.partitionBy("h1", "h2").orderBy("doc", "pos")
    parts = []
    for t in (blocks, windows):
        parts.append(t.where(F.col("kind") == FOUND).select("doc", "pos", F.col("h1").alias("source"), F.col("h2").alias("at")))
        entries = t.where(F.col("kind") == ENTRY).select("h1", "h2", "doc", "pos")
        settled = entries.select("doc", "pos", F.first("doc").over(same).alias("source"), F.shiftright(F.first("pos").over(same), 4).alias("at"))
        parts.append(settled.where(F.col("source") < F.col("doc")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = keep(found, "spans")
    discard(blocks)
    discard(windows)
    release(docs.sparkSession)
    return found


def factor(pos: np.ndarray, source: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Greedy parse of one document: rows (first word, length, source document, its word), in order and without overlap.

    A factor goes on while what is found next continues its source; what another
    source has begins a new factor, where the one before ends.
    """
    lo, cnt = pos >> 4, pos & 15
    order = np.lexsort((-cnt, lo))
    lo, source, at, end = lo[order], source[order], at[order], (lo + cnt + window - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.ones(len(lo), bool)
    shift = at - lo
    new[1:] = (source[1:] != source[:-1]) | (shift[1:] != shift[:-1]) | (lo[1:] > reach[:-1])
    first = np.flatnonzero(new)
    stop = reach[np.append(first[1:], len(lo)) - 1]
    begin = np.maximum(lo[first], np.concatenate([[0], stop[:-1]]))
    out = np.stack([begin, stop - begin, source[first], begin + shift[first]], axis=1)
    return out[out[:, 1] > 0]


FACTORS = "array<struct<first:int,length:int,source:long,at:int>>"


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space), factors (first word, length, source document, its first word)."""

    def run(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("at", pa.int32())]))
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            parts = batch.column(2)
            flat, offsets = parts.values, np.asarray(parts.offsets)
            pos, source, at = (np.asarray(flat.field(k)) for k in range(3))
            given = np.asarray(parts.is_valid())
            for i, text in enumerate(batch.column(1)):
                w = (text.as_py() or "").encode().split()
                gone, runs = np.zeros(len(w), bool), []
                if given[i]:
                    of = slice(offsets[i], offsets[i + 1])
                    for first, length, src, a in factor(pos[of], source[of], at[of], window).tolist():
                        gone[first : first + length] = True
                        runs.append({"first": first, "length": length, "source": src, "at": a})
                kept = b" ".join(np.array(w, object)[~gone].tolist() if runs else w)
                for col, v in zip(out, (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), runs), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], kind)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    found = located(docs, window)
    found = found.groupBy(F.col("doc").alias("_tm_id")).agg(F.collect_list(F.struct("pos", "source", F.col("at").cast("long").alias("at"))).alias("parts"))
    joined = docs.join(found, docs["doc_id"] == found["_tm_id"], "left").select("doc_id", "text", "parts")
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, factors {FACTORS}")
