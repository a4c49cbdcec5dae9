"""Mixing to target weights with soft memberships.

The domains are the classes of the labelled table (quality and toxicity of a
document). A softmax classifier over hashed words, fitted on a bounded sample
of labelled rows, gives each document posteriors p over the domains. Document
rates x >= 0 are fitted so that the expected tokens of each domain,
sum(x * tokens * p), match the target weights of the present total, by
projected-gradient least squares with a small pull towards rate 1:

    minimise 1/2 |sum(u x p) - t|**2 + PULL/2 sum(u (x - 1)**2),  u: share of tokens

A plain gradient is slow in the direction of a domain with few tokens. So a step
takes the gradient in the metric of the K x K matrix of second moments
sum(u p p') of the documents with a rate above 0, and projects at 0. In that
metric all rates are max(0, 1 - p.m) for one vector m of K numbers: a step is one
pass over the memberships that sums K residuals, the matrix and the objective; a
step that doesn't lower the objective is halved. Some ten passes are enough, no
table of rates is written, and an executor that is lost costs the tasks it ran.

Defined results: a null or empty text has no tokens, and posteriors like an
empty document's; without labels there is one domain and all rates are 1;
targets for domains that no label names are left out and the others scaled to
1; a null doc_id is passed on; repeated rows are rated once each (in ``mix``,
rows that share an id are drawn together, at the highest rate of them); an empty
table gives an empty result; further columns are ignored (or, in ``mix``,
passed on).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, PLAIN, chunks, lists, words
from .scratch import keep

FEATURES = 1 << 16
#: Most labelled documents of each domain that the classifier takes, and the most bytes of one domain's texts.
SAMPLE = 1500
SAMPLE_BYTES = 8 << 20
PULL = 1e-5
#: Most passes over the memberships, and the size of the gradient at which they end.
STEPS = 40
SETTLED = 1e-7
#: Shares of tokens wanted of each domain: q quality, t toxicity.
TARGETS = {"q1t0": 0.9, "q1t1": 0.04, "q0t0": 0.05, "q0t1": 0.01}


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature) of the distinct hashed words of each text, and tokens by document."""
    docs, found, tokens = [], [], []
    for c in chunks(text):
        w = words(c, ALNUM)
        key = np.unique((w.row_of() + c.first) << 16 | (w.hash >> np.uint64(48)).astype(np.int64))
        docs.append(key >> 16)
        found.append(key & (FEATURES - 1))
        tokens.append(np.diff(words(c, PLAIN).rows))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x or [none]) for x in (docs, found, tokens))


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
        z = np.stack([np.bincount(doc, w[feature], n) * scale for w in self.weights], axis=1) + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(doc: np.ndarray, feature: np.ndarray, domain: np.ndarray, names: list[str], prior: np.ndarray, epochs: int = 60) -> Classifier:
    n, k = len(domain), len(names)
    model = Classifier(names, np.zeros((k, FEATURES)), np.log(np.bincount(domain, minlength=k) / n + 1e-9))
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
    truth = np.eye(k)[domain]
    squares = np.full((k, FEATURES), 1e-8)
    for _ in range(epochs):
        off = model.posteriors(doc, feature, n) - truth
        for j in range(k):
            g = np.bincount(feature, (off[:, j] * scale)[doc], FEATURES) / n + 1e-6 * model.weights[j]
            squares[j] += g * g
            model.weights[j] -= 0.5 * g / np.sqrt(squares[j])
    model.bias += np.log(prior + 1e-9) - np.log(np.bincount(domain, minlength=k) / n + 1e-9)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """From ``sample`` labelled documents of each domain at most, in the order of a hash of their ids."""
    marks = labels.where("quality is not null and toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    marks = marks.select("doc_id", F.concat(F.lit("q"), F.col("q").cast("string"), F.lit("t"), F.col("t").cast("string")).alias("domain"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = texts.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).join(marks, "doc_id")
    shares = sorted((r.domain, r["count"]) for r in sized.groupBy("domain").count().collect())
    if not shares:
        return Classifier(["all"], np.zeros((1, FEATURES)), np.zeros(1))
    names = [d for d, _ in shares]
    prior = np.array([c for _, c in shares], float) / sum(c for _, c in shares)
    chosen: dict[int, int] = {}
    for j, name in enumerate(names):
        room = SAMPLE_BYTES
        for r in sized.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
            if room >= (r.n or 0):
                room -= r.n or 0
                chosen.setdefault(r.doc_id, j)
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")
    # Of rows that repeat an id, the smallest text.
    table = texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).toArrow()
    table = table.sort_by("doc_id")
    doc, feature, _ = features(table["text"].combine_chunks())
    return fit(doc, feature, np.array([chosen[d] for d in table["doc_id"].to_pylist()]), names, prior)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens, posteriors."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.weights, model.bias))

    def run(batches):
        known = Classifier(*shared.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            doc, feature, tokens = features(batch.column(1))
            p = known.posteriors(doc, feature, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), lists(p.ravel(), np.full(n, p.shape[1]), pa.float64())], ["doc_id", "tokens", "posteriors"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, tokens long, posteriors array<double>")


def rates_at(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rates of documents by their posteriors."""
    return np.maximum(0, 1 - p @ m)


def _matrix(column, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, k)


def _sums(rows: DataFrame, m: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(tokens, tokens at squared rates, tokens of each domain at the rates, second moments of documents with a rate above 0)."""
    k = len(m)

    def run(batches):
        sums = np.zeros(2 + k + k * k)
        for batch in batches:
            if batch.num_rows:
                p, n = _matrix(batch.column(1), k), np.asarray(batch.column(0)).astype(np.float64)
                x = rates_at(p, m)
                own = p[x > 0]
                sums += np.concatenate([[n.sum(), n @ x**2], (n * x) @ p, ((n[x > 0, None] * own).T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([s]) for s in sums], [f"s{j}" for j in range(len(sums))])

    names = [f"s{j}" for j in range(2 + k + k * k)]
    made = rows.select("tokens", "posteriors").mapInArrow(run, ", ".join(f"{c} double" for c in names))
    got = np.array([s or 0.0 for s in made.agg(*[F.sum(c) for c in names]).first()])
    return got[0], got[1], got[2 : 2 + k], got[2 + k :].reshape(k, k)


def solve(rows: DataFrame, k: int, target: np.ndarray, pull: float = PULL, steps: int = STEPS) -> np.ndarray:
    """The vector m of the rates. rows: tokens, posteriors, in a table that is read once a step."""
    m, move, least = np.zeros(k), np.zeros(k), np.inf
    for _ in range(steps):
        total, squared, reached, moments = _sums(rows, m + move)
        if not total:
            break
        size = pull / 2 * (m + move) @ (m + move) + target @ (m + move) + squared / total / 2
        if size > least + 1e-12:
            move = move / 2
            continue
        m, least = m + move, size
        gradient = pull * m + target - reached / total
        if np.abs(gradient).max() <= SETTLED:
            break
        move = -np.linalg.solve(moments / total + pull * np.eye(k), gradient)
    return m


def totals(rated: DataFrame) -> dict[str, float]:
    """Expected share of the present tokens that each domain has at the rates, to be held against the targets."""
    pairs = F.explode(F.arrays_zip("domains", "posteriors")).alias("d")
    of = rated.select("tokens", "rate", pairs).groupBy("d.domains").agg(F.sum(F.col("tokens") * F.col("rate") * F.col("d.posteriors")).alias("reached"), F.sum("tokens").alias("tokens"))
    return {r.domains: r.reached / r.tokens for r in of.collect() if r.tokens}


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, pull: float = PULL, steps: int = STEPS) -> DataFrame:
    """doc_id, tokens, domains, posteriors, rate, copies: the rate rounded up or down by a hash of the id, to the rate on average."""
    model = train(docs, labels)
    wanted = np.array([(targets or TARGETS).get(d, 0.0) for d in model.names])
    wanted = wanted / wanted.sum() if wanted.sum() else np.full(len(wanted), 1 / len(wanted))
    rows = keep(memberships(docs, model), "memberships")
    k = len(model.names)
    m = solve(rows, k, wanted, pull, steps)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = rates_at(_matrix(batch.column(2), k), m)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x)], ["doc_id", "tokens", "posteriors", "rate"])

    rated = rows.mapInArrow(run, "doc_id long, tokens long, posteriors array<double>, rate double")
    draw = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select("doc_id", "tokens", F.array(*[F.lit(d) for d in model.names]).alias("domains"), "posteriors", "rate", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents that are drawn at least once, with rate and copies added (in place of columns of these names)."""
    drawn = F.max(F.struct("rate", "copies"))
    rated = rates(docs, labels, targets).where("copies > 0").groupBy(F.col("doc_id").alias("_tm_id")).agg(drawn.alias("_tm_drawn"))
    joined = docs.drop("rate", "copies").join(rated, docs["doc_id"].eqNullSafe(rated["_tm_id"]))
    return joined.withColumns({"rate": F.col("_tm_drawn.rate"), "copies": F.col("_tm_drawn.copies")}).drop("_tm_id", "_tm_drawn")
