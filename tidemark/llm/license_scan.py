"""License scans: exact phrases, and short notices found with errors allowed.

A notice of m characters may differ by k = m // 12 edits. It is cut into k + 1
pieces; by the pigeonhole principle one of them stands unchanged in any text
within k edits, so plain substring search for the pieces locates candidates.
Around each candidate the ``regex`` library finds the best match of the notice
with at most k errors, then those before and after it, and reports span and edits.

Defined results: a null or empty text has no words, labels or score; repeated
rows are scanned once each; a null doc_id is passed on; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, chunks, hash_of, words

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, lower-case words joined by one space, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "proprietary",
}
CHARS_PER_EDIT = 12


class Notice:
    def __init__(self, text: str, label: str):
        self.text, self.label = text, label
        self.edits = len(text) // CHARS_PER_EDIT
        n = self.edits + 1
        cuts = [len(text) * i // n for i in range(n + 1)]
        self.seeds = [(text[a:b].encode(), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.pattern = regex.compile(f"(?be)(?:{regex.escape(text)}){{e<={self.edits}}}")

    def search(self, norm: bytes) -> list[tuple[int, int, int]]:
        """(begin, end, edits) of matches in normalised text, in bytes; each region is verified once."""
        regions = []
        for seed, offset in self.seeds:
            at = norm.find(seed)
            while at >= 0:
                regions.append((max(at - offset - 4 * self.edits, 0), at - offset + len(self.text) + 4 * self.edits))
                at = norm.find(seed, at + 1)
        found = set()
        for a, b in _merged(regions):
            piece = norm[a:b]
            text = piece.decode("utf-8", "ignore")
            skip = len(piece) - len(piece.lstrip(bytes(range(0x80, 0xC0)))) if piece else 0
            parts = [(0, len(text))]
            while parts:
                low, high = parts.pop()
                # A match holds one of the pieces unchanged.
                if not any(text.find(seed.decode(), low, high) >= 0 for seed, _ in self.seeds):
                    continue
                # The best match of a part; others may stand on both sides of it.
                if m := self.pattern.search(text, low, high):
                    begin = a + skip + len(text[: m.start()].encode())
                    found.add((begin, begin + len(m.group().encode()), sum(m.fuzzy_counts)))
                    parts += [(low, m.start()), (m.end(), high)]
        return sorted(found)


def _merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(regions):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def normalised(chunk) -> tuple[bytes, np.ndarray]:
    """Lower-case words joined by single spaces, for all rows of a chunk, and where each row begins."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[~ALNUM.word] = 32
    table[65:91] = np.arange(97, 123)
    data = table[chunk.data]
    stay = data != 32
    gap = ~stay
    inner = gap.copy()
    inner[1:] &= ~gap[:-1]
    heads = chunk.offsets[:-1][chunk.offsets[:-1] < len(data)]
    inner[heads] = False
    take = stay | inner
    begins = np.concatenate([[0], np.cumsum(take)])[chunk.offsets]
    return data[take].tobytes(), begins


def base_places(w, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word in the chunk, phrase number) of each base phrase that stands in one row."""
    at, which = [], []
    for k, phrase in enumerate(PHRASES):
        terms = [np.uint64(hash_of(t, ALNUM)) for t in phrase.split()]
        n = len(w.hash) - len(terms) + 1
        if n <= 0:
            continue
        hit = np.flatnonzero(w.hash[:n] == terms[0])
        for j, t in enumerate(terms[1:], 1):
            hit = hit[w.hash[hit + j] == t]
        hit = hit[row[hit] == row[hit + len(terms) - 1]]
        at.append(hit)
        which.append(np.full(len(hit), k))
    return np.concatenate(at or [np.zeros(0, np.int64)]), np.concatenate(which or [np.zeros(0, np.int64)])


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,begin:int,end:int,edits:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document; spans are those of the fuzzy matches in the normalised text, in bytes."""

    def run(batches):
        notices = [Notice(t, label) for t, label in NOTICES.items()]
        bases = list(PHRASES.values())
        kind = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for c in chunks(batch.column(1)):
                w = words(c, ALNUM)
                row = w.row_of()
                at, which = base_places(w, row)
                own: dict[int, list[tuple[int, int]]] = {}
                for i, k in zip(at.tolist(), which.tolist(), strict=True):
                    own.setdefault(int(row[i]), []).append((i - int(w.rows[row[i]]), k))
                norm, begins = normalised(c)
                spans = _fuzzy(norm, begins, notices)
                for r in range(c.rows):
                    mine, near = own.get(r, []), spans.get(r, [])
                    base = sorted({bases[k] for _, k in mine})
                    labels = sorted({*base, *(s["label"] for s, _ in near)})
                    score = 1.0 if mine else max((q for _, q in near), default=0.0)
                    places = [i for i, _ in mine]
                    for col, v in zip(cols, (int(w.rows[r + 1] - w.rows[r]), len(mine), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), score, [s for s, _ in near]), strict=True):
                        col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), kind]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCAN)


def _fuzzy(norm: bytes, begins: np.ndarray, notices: list[Notice]) -> dict[int, list]:
    """Row -> [(span, similarity)]. Seeds are searched for in the whole chunk, then each row that has one is verified alone."""
    found: dict[int, list] = {}
    for notice in notices:
        rows = set()
        for seed, _ in notice.seeds:
            at = norm.find(seed)
            while at >= 0:
                r = int(np.searchsorted(begins, at, "right")) - 1
                rows.add(r)
                at = norm.find(seed, max(at + 1, int(begins[r + 1]) - len(seed) + 1))
        for r in sorted(rows):
            for a, b, edits in notice.search(norm[begins[r] : begins[r + 1]]):
                span = {"label": notice.label, "begin": a, "end": b, "edits": edits}
                found.setdefault(r, []).append((span, 1 - edits / len(notice.text)))
    return {r: _best(x) for r, x in found.items()}


def _best(spans: list) -> list:
    """Without those that overlap a span of fewer edits."""
    return [x for x in spans if not any(y[0]["edits"] < x[0]["edits"] and y[0]["begin"] < x[0]["end"] and x[0]["begin"] < y[0]["end"] for y in spans)]
