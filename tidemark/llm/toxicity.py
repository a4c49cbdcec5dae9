"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the hashed words in it, and the document's score is the noisy-or of its
sentences: 1 - prod(1 - p). Weights are learned from document labels alone, by
gradient descent through the noisy-or on a bounded sample of labelled rows; the
sentence scores then tell which sentences offend.

Defined results: a null or empty text scores like an empty sentence; labels
that are null are not learned from; a document labelled both ways counts as
toxic; without any labelled row every score is the prior 0; a null doc_id is
scored, with held_out null, and not learned from; repeated rows are scored
once each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, chunks, words

FEATURES = 1 << 18
#: Most labelled documents of each class that training takes, in the order of a hash of their ids.
SAMPLE = 6000
#: ... and the most bytes of text that they may have together.
SAMPLE_BYTES = 48 << 20
EPOCHS = 160
#: Score from which a sentence of a toxic document is reported.
OFFENDS = 0.5
#: A word has a weight if this share of the training documents holds it, three of them at least.
SUPPORT = 0.003
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Bags:
    """Distinct (sentence, word) pairs of some documents; sentences numbered in order."""

    sentence: np.ndarray
    feature: np.ndarray
    document: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def bags(text: pa.Array) -> Bags:
    """Every text as sentences: cut at . ! ? and line ends; a text has one sentence at least."""
    parts = []
    made = 0
    for c in chunks(text):
        w = words(c, ALNUM)
        stops = np.concatenate([[0], np.cumsum(ENDS[c.data])])
        row = w.row_of()
        # A word's cut: the stops before it in its row. Cuts are renumbered so that those with words are consecutive.
        cut = stops[w.start] - stops[c.offsets[row]]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (cut[1:] != cut[:-1])
        sentence = np.cumsum(new) - 1
        owner, begin = row[new], w.start[new] - c.offsets[row[new]]
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(row) - 1]])[: len(owner)].astype(np.int64)
        end = w.end[last] - c.offsets[owner]
        bare = np.setdiff1d(np.arange(c.rows), owner)
        key = np.unique(sentence.astype(np.int64) << 18 | (w.hash >> np.uint64(46)).astype(np.int64))
        n = len(owner)
        parts.append(
            (
                (key >> 18) + made,
                key & (FEATURES - 1),
                np.concatenate([owner, bare]) + c.first,
                np.concatenate([begin, np.zeros(len(bare), np.int64)]),
                np.concatenate([end, np.zeros(len(bare), np.int64)]),
            )
        )
        made += n + len(bare)
    if not parts:
        return Bags(*[np.zeros(0, np.int64)] * 5)
    return Bags(*[np.concatenate(x) for x in zip(*parts, strict=True)])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        z = np.bincount(b.sentence, self.weights[b.feature], len(b.document)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def documents(self, b: Bags, n: int) -> np.ndarray:
        p = np.minimum(self.sentences(b), 1 - 1e-12)
        return 1 - np.exp(np.bincount(b.document, np.log1p(-p), n))


def fit(b: Bags, toxic: np.ndarray, share: float, epochs: int = EPOCHS, sparse: float = 1e-5) -> Model:
    """Proximal gradient descent (Adagrad) on the log-loss of the noisy-or; the L1 term keeps words of a few documents out. share: toxic documents among all labelled."""
    n = len(toxic)
    model = Model(np.zeros(FEATURES), -8.0)
    pairs = np.unique(b.document[b.sentence] << 18 | b.feature)
    common = np.bincount(pairs & (FEATURES - 1), minlength=FEATURES) >= max(3, SUPPORT * n)
    b = Bags(b.sentence[common[b.feature]], b.feature[common[b.feature]], b.document, b.begin, b.end)
    importance = np.where(toxic == 1, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    importance = 0.5 * importance + 0.5
    squares, bias_square = np.full(FEATURES, 1e-6), 1e-6
    for _ in range(epochs):
        p = np.minimum(model.sentences(b), 1 - 1e-12)
        clean = np.exp(np.bincount(b.document, np.log1p(-p), n))
        pull = np.where(toxic == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * importance
        slope = p * pull[b.document]
        g = np.bincount(b.feature, slope[b.sentence], FEATURES) / n
        squares += g * g
        step = 0.6 / np.sqrt(squares)
        moved = model.weights - step * g
        model.weights = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0)
        g0 = slope.sum() / n
        bias_square += g0 * g0
        model.bias -= 0.3 * g0 / np.sqrt(bias_square)
    return model


def held_out(folds: int = 5):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From labelled documents outside the held-out fold, ``sample`` of each class at most."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    share = marks.agg(F.avg("toxic")).first()[0]
    if share is None:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.octet_length("text").alias("n"))
    order = F.xxhash64(F.col("doc_id"))
    ranked = texts.groupBy("doc_id").agg(F.max("n").alias("n")).join(marks, "doc_id").withColumn("o", order)
    picked = None
    for kind in (0, 1):
        part = ranked.where(F.col("toxic") == kind).orderBy("o", "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = picked.select("doc_id", "n", "toxic", "o").collect()
    room, chosen = {0: SAMPLE_BYTES // 2, 1: SAMPLE_BYTES // 2}, {}
    for r in sorted(rows, key=lambda r: (r.o, r.doc_id)):
        if (room[r.toxic] - (r.n or 0)) >= 0:
            room[r.toxic] -= r.n or 0
            chosen[r.doc_id] = r.toxic
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long") if chosen else None
    if ids is None:
        return None
    # Of rows that repeat an id, the smallest text.
    table = texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).toArrow().combine_chunks()
    found = table["doc_id"].to_pylist()
    at = {d: i for i, d in enumerate(found)}
    keep = sorted(at.values(), key=lambda i: found[i])
    table = table.take(pa.array(keep))
    toxic = np.array([chosen[found[i]] for i in keep])
    return fit(bags(table["text"].combine_chunks()), toxic, float(share))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, worst_begin, worst_end (bytes of the worst sentence), worst_score, offending.

    ``offending``: the sentences of score OFFENDS or more, in order (bytes, score); none in a clean document.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.weights, model.bias))

    def run(batches):
        known = shared.value and Model(*shared.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            b = bags(batch.column(1))
            if known is None:
                p, s = np.zeros(n), np.zeros(len(b.document))
            else:
                p, s = known.documents(b, n), known.sentences(b)
            order = np.lexsort((b.begin, -s, b.document))
            first = order[np.searchsorted(b.document[order], np.arange(n))]
            bad = np.flatnonzero((s >= OFFENDS) & (p[b.document] >= OFFENDS))
            bad = bad[np.lexsort((b.begin[bad], b.document[bad]))]
            edges = np.concatenate([[0], np.cumsum(np.bincount(b.document[bad], minlength=n))]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(b.begin[bad]), pa.array(b.end[bad]), pa.array(s[bad])], ["begin", "end", "score"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array(np.bincount(b.document, minlength=n)), pa.array(b.begin[first]), pa.array(b.end[first]), pa.array(s[first]), pa.ListArray.from_arrays(pa.array(edges), spans)],
                ["doc_id", "score", "n_sentences", "worst_begin", "worst_end", "worst_score", "offending"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(run, "doc_id long, score double, n_sentences long, worst_begin long, worst_end long, worst_score double, offending array<struct<begin:long,end:long,score:double>>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_begin", "worst_end", "worst_score", "offending")
