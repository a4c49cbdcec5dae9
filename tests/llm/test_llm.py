"""The training-data operators against brute force, and on odd input."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import kneser_ney, license_scan, line_dedup, log_bilinear, mixing, permutation_index, positional_index, rlz_dedup, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    passage, line = say(40), "A line that many documents share"
    out = {i: "\n".join(say(int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 6)))) for i in range(40)}
    for i in range(40, 60):
        out[i] = say(12) + " " + passage[: int(rng.integers(20, len(passage)))] + "\n" + line + ("  " if i % 2 else "") + "\n" + say(9)
    out[60], out[61], out[62] = out[3], out[3], out[45]
    out[63] = (out[41].split("\n")[0] + " " + passage + " end") * 3
    out[64], out[65], out[66], out[67] = None, "", "  \t\n ", "x " * 400
    out[68] = "the MIT license here, and apache License. Licensed under the Apache Licence, Version 2.0 General public LICENSE"
    out[69] = say(30_000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, None, None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, 1 if i % 4 else 0, 1 if i % 7 == 0 else 0) for i in texts if i % 2 == 0] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def brute_rlz(texts, window=13):
    first = {}
    for i in sorted(texts):
        w = spaced(texts[i])
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = {}
    for i, t in texts.items():
        w = spaced(t)
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substrings(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz_dedup.dedup_substrings(docs.withColumn("key", F.lit(1)).withColumn("parts", F.lit(2))).collect()}
    assert got == brute_rlz(texts) and sum(v[1] for v in got.values()) > 300


def test_a_passage_twice_in_a_document_goes_twice(spark):
    """The smallest document of one task has a passage at two places, and a document of another task is smaller: both places go."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice([f"v{i}" for i in range(500)], n))
    passage, shorter = say(40), say(14)
    texts = {1: f"{say(5)} {passage} {say(6)} {shorter}", 5: f"{passage} {say(9)} {passage} {say(7)} {shorter} {say(3)} {shorter}", 6: f"{say(8)} {shorter} {shorter} {passage}"}
    apart = spark.createDataFrame(spark.sparkContext.parallelize(sorted(texts.items()), 2), "doc_id long, text string")  # 1 | 5, 6
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rlz_dedup.dedup_substrings(apart).collect()}
    assert got == brute_rlz(texts) and got[5][1] == 2 * 40 + 2 * 14 and got[6][1] == 40 + 2 * 14


def test_factors_are_copies_of_their_sources(docs, texts):
    """A document is its literals and its factors, each a copy of words of a smaller document."""
    factors = 0
    for r in rlz_dedup.dedup_substrings(docs).collect():
        w, end = spaced(texts[r.doc_id]), 0
        rebuilt = list(w)
        for f in r.factors:
            assert f.first >= end and f.source < r.doc_id
            end = f.first + f.length
            rebuilt[f.first : end] = spaced(texts[f.source])[f.at : f.at + f.length]
        assert rebuilt == w and sum(f.length for f in r.factors) == r.n_removed
        factors += len(r.factors)
    whole = {r.doc_id: r.factors for r in rlz_dedup.dedup_substrings(docs).where("doc_id = 61").collect()}[61]
    n = len(spaced(texts[61]))
    assert factors > 20 and (n < 13 or [(f.first, f.length, f.at) for f in whole] == [(0, n, 0)])


def test_greedy_parse():
    """A factor goes on while its source goes on; another source begins where it ends."""
    one = lambda *rows: rlz_dedup.factor(*np.array([(lo << 4 | cnt, src, at) for lo, cnt, src, at in rows], np.int64).T, 13).tolist()
    assert one((0, 3, 5, 40), (3, 9, 5, 43), (12, 1, 5, 52)) == [[0, 25, 5, 40]]
    assert one((0, 3, 5, 40), (3, 9, 6, 7), (40, 2, 5, 80)) == [[0, 15, 5, 40], [15, 9, 6, 19], [40, 14, 5, 80]]
    assert one((10, 9, 5, 40), (12, 1, 6, 0)) == [[10, 21, 5, 40]]


def test_lines(docs, texts):
    keep = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UP)
    for i in sorted(texts):
        for x in (texts[i] or "").split("\n"):
            keep.setdefault(key(x), []).append(i)
    want = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or keep[key(x)][0] == i]
        want[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(docs).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 15


def test_simhash(docs, texts):
    def fp(t):
        w = spaced((t or "").translate(UP))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fp(t) for i, t in texts.items()}
    up = {i: i for i in prints}
    root = lambda i: i if up[i] == i else root(up[i])
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect()}
    assert got == {i: (f"{p:016x}", root(i)) for i, p in prints.items()}


@pytest.mark.parametrize("tile", [4096, 30])
def test_similar_components(spark, tile, monkeypatch):
    """Against the Jaccard similarity of all pairs: from 0.87 linked, below 0.8 not; a group of copies with one word changed is whole."""
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (tile,))
    rng = np.random.default_rng(3)
    texts, at = {0: "", 1: None, 2: "  "}, 3
    for base in range(40):
        old = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        texts[at] = " ".join(old)
        for changes in (0, 1, 2, 12):
            new = list(old)
            for k in rng.choice(200, changes, replace=False):
                new[k] = f"x{base}n{k}"
            at += 1
            texts[at] = " ".join(new)
        at += 1
    old = [f"h{x}" for x in range(300)]
    for k in range(300):
        texts[at + k] = " ".join([*old[:k], "other", *old[k + 1 :]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert set(got) == set(texts)
    assert {got[i] for i in (0, 1, 2)} == {0} and {got[at + k] for k in range(300)} == {at}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, (t or "").split()) for i, t in texts.items())}
    for i in range(3, at):
        for j in range(i + 1, at):
            s = len(grams[i] & grams[j]) / len(grams[i] | grams[j])
            assert s < 0.87 or got[i] == got[j]
            assert s >= 0.8 or got[i] != got[j]
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_similar_components_of_edited_families(spark):
    """Families of copies edited to around 0.8: a link that holds is not lost to candidates that are deleted afterwards, only to the deals (0.05)."""
    rng = np.random.default_rng(8)
    texts = []
    for base in range(30):
        old = [f"b{base}w{k}" for k in range(300)]
        for copy in range(24):
            new = list(old)
            for k in rng.choice(300, 4, replace=False):
                new[k] = f"c{copy}k{k}"
            texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    prints = np.array([simhash.wide_fingerprint(t.encode(), 5) for t in texts], np.uint64)
    met = lost = 0
    for i in range(len(texts)):
        for j in range(i + 1, i // 24 * 24 + 24):
            same = len(sets[i] & sets[j])
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same) and np.bitwise_count(prints[i] ^ prints[j]).sum() <= 46:
                met, lost = met + 1, lost + (got[i] != got[j])
    assert met > 100 and lost <= 0.05 * met


@pytest.mark.parametrize("tile", [4096, 40])
def test_bit_slices_and_tiles(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fps = np.unique(np.concatenate([base, *[base[:5] ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))]]))
    for radius in (4, 18):
        want = np.argwhere(np.bitwise_count(fps[:20, None] ^ fps) <= radius)
        query, lane = simhash.within(fps[:20], simhash.planes(fps), radius)
        assert sorted(zip(query[lane < len(fps)].tolist(), lane[lane < len(fps)].tolist(), strict=True)) == [tuple(x) for x in want.tolist()]
    reps = spark.createDataFrame([(int(f.astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, id long")
    found = simhash.near_links(reps, 4, tile).collect()
    forest, truth = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    for r in found:
        forest.join(r.a, r.b)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4).tolist():
            truth.join(i, j)
    assert [forest.root(i) for i in range(len(fps))] == [truth.root(i) for i in range(len(fps))]


def test_decontamination(spark, docs, texts, monkeypatch):
    tests = [(1, " ".join(alnum(texts[42])[4:18])), (2, "apache license"), (3, None), (10, texts[69][5000:5200]), (11, "x x x x x x x x x x x"), (None, "word1")]
    want = {}
    for i, t in texts.items():
        w, hit, items = alnum(t), set(), set()
        for k, text in tests:
            b = alnum(text)
            n = min(10, len(b))
            for s in range(len(b) - n + 1) if n and k else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(k))
        want[i] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    table = spark.createDataFrame(tests, "item_id long, text string")
    monkeypatch.setattr(positional_index, "SHARD", 700)
    for block in (1 << 20, 100):
        found = positional_index.search(docs, table, block_bytes=block)
        assert {r.doc_id: (r.n_words, len(r.hits), len(r.items)) for r in found.collect()} == {i: v[:3] for i, v in want.items()}
    got = positional_index.contamination(docs, table).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    near = positional_index.search(docs, spark.createDataFrame([(1, "license mit")], "item_id long, text string"), span=3)
    assert [r.doc_id for r in near.where("size(items) > 0").collect()] == [68]


def test_proximity_beside_phrases(spark, docs, texts, monkeypatch):
    """Against every place and window: within a span, in any order, in one document only; several shards and blocks."""
    tests = [(1, " ".join(alnum(texts[42])[4:18][::-1])), (2, "license mit"), (3, "license license"), (4, " ".join(alnum(texts[69])[90:100]))]
    want = {}
    for i, t in texts.items():
        w, places, items = alnum(t), set(), set()
        for k, text in tests:
            b = alnum(text)
            n = min(10, len(b))
            for s in range(len(b) - n + 1):
                terms = set(b[s : s + n])
                hit = {p for p in range(len(w)) if w[p] == b[s] and terms <= set(w[max(p - 15, 0) : p + 16])}
                places |= hit
                items |= {k} if hit else set()
        want[i] = (len(places), len(items))
    table = spark.createDataFrame(tests, "item_id long, text string")
    monkeypatch.setattr(positional_index, "SHARD", 700)
    for block in (1 << 20, 100):
        found = positional_index.search(docs, table, near=15, block_bytes=block).collect()
        assert {r.doc_id: (len(r.near), len(r.near_items)) for r in found} == want
    got = positional_index.contamination(docs, table, near=15).collect()
    assert {r.doc_id: (r.n_near, r.n_near_items) for r in got} == want and sum(v[0] for v in want.values()) > 5


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    r = got[68]
    assert (r.n_base, r.first_word, r.base_labels, r.score) == (3, 1, "apache,gpl,mit", 1.0)
    assert any(s.label == "apache" and s.edits == 1 for s in r.spans)
    assert got[64].n_words == 0 and got[64].labels == "" and got[0].first_word is None


def fuzzy(text, notice, most):
    """Whether ``notice`` stands in ``text`` with at most ``most`` edits: Sellers' table."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for ch in text:
        new = [0]
        for j, x in enumerate(notice, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (ch != x)))
        row = new
        best = min(best, row[-1])
    return best <= most


def test_licenses_against_brute_force(spark):
    """All columns: base places by words, labels by an edit table over the whole text, on notices with few and too many edits."""
    rng = np.random.default_rng(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = {0: None, 1: "", 2: "MIT license mit LICENSE, the Apache-License; general public\nlicense", 3: "mit é license"}
    for i, (notice, _) in enumerate(license_scan.NOTICES.items()):
        for edits in range(0, len(notice) // license_scan.CHARS_PER_EDIT + 3):
            w = list(notice)
            for k in rng.choice(len(w) - 2, edits, replace=False) + 1:
                w[k] = ["", letters[int(rng.integers(26))], w[k] + letters[int(rng.integers(26))]][int(rng.integers(3))]
            texts[100 * (i + 1) + edits] = "some Words, " + "".join(w) + " and more"
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    for i, t in texts.items():
        w, r = alnum(t), got[i]
        at = [(p, label) for phrase, label in license_scan.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        places = [p for p, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        base = {label for _, label in at}
        found = {label for notice, label in license_scan.NOTICES.items() if fuzzy(" ".join(w), notice, len(notice) // license_scan.CHARS_PER_EDIT)}
        assert r.base_labels == ",".join(sorted(base))
        mine = {s.label for s in r.spans}
        # A span that a better one overlaps isn't reported; its text is near the other notice.
        assert mine <= found and (set(r.labels.split(",")) - {""}) == base | mine and (mine or not found)
        assert r.score == 1.0 if at else (0 < r.score <= 1.0) == bool(mine)


def test_notices_before_a_better_one():
    notice = license_scan.Notice("released under the mit license", "mit")
    assert notice.search(b"released under the mitt license released under the mit license") == [(0, 31, 1), (32, 62, 0)]
    names = ["mitt", "mit", "miit", "mt", "mit", "mitt"] * 300
    text = " ".join(f"released under the {x} license" for x in names)
    got = notice.search(text.encode())
    assert [e for _, _, e in got] == [int(x != "mit") for x in names] and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vecs = np.concatenate([rng.normal(0, 1, (400, 16)) + rng.normal(0, 3, (8, 16)).repeat(50, axis=0), np.ones((60, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] * 16), (1003, [1.0, 2.0]), (None, [1.0] * 16), (450, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("nth", F.lit(0)).repartition(3)
    got = permutation_index.search(df, F.col("id") % 10 == 0, share=0.5).collect()
    hit = total = 0
    for q in range(0, 460, 10):
        d = np.sqrt(((vecs - vecs[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(460), d))[:10].tolist()
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [k for k, _ in mine] == list(range(1, 11))
        hit, total = hit + len({v for _, v in mine} & set(want)), total + 10
        if q >= 400:
            assert [v for _, v in mine] == want
    assert hit / total >= 0.9
    assert permutation_index.search(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_recall_of_the_default(spark, monkeypatch):
    """On sf0.1, by the defaults, over several shards and blocks of queries, against the exact search in SQL."""
    duckdb = pytest.importorskip("duckdb")
    from tidemark.llm.oracle import NEAREST

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 7)
    monkeypatch.setattr(permutation_index, "SHARD", 800)
    monkeypatch.setattr(permutation_index, "EACH", 1)  # so that SHARE alone decides: less than a tenth of each shard
    assert permutation_index.SHARE < 0.1
    got = permutation_index.search(spark.read.parquet(path), F.col("id") % 100 == 0).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = {(q, v): s for q, _, v, s in db.sql(NEAREST).fetchall()}
    hits = [(r, want[r.query_id, r.vec_id]) for r in got if (r.query_id, r.vec_id) in want]
    assert len(got) == len(want) == 200 and len(hits) >= 0.95 * len(want)
    assert all(r.score == pytest.approx(s, rel=1e-12) for r, s in hits)


def test_neighbours_of_each_length(spark):
    """A length that few vectors have is searched too."""
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(4)]
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(100, 1, 101), (100, 2, 102), (100, 3, 103)]


def test_language_model(docs, texts):
    tokens = {i: spaced((t or "").translate(UP)) + [None] for i, t in texts.items()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, w in tokens.items() if not out(i) for x in w)
    n, v = sum(c.values()), len(c)
    for r in log_bilinear.scores(docs).collect():
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_lbl_normalised_and_learns():
    """Probabilities of all tokens sum to one for any context; a token that follows from the one before is learned."""
    rng = np.random.default_rng(0)
    counts = np.sort(rng.zipf(1.3, 600).clip(1, 5000))[::-1].astype(float)
    shape = log_bilinear.shape_of(counts)
    assert shape.bounds[-1] == shape.tokens == 600 and len(shape.bounds) > 20
    one, two = rng.integers(0, 600, 40000), rng.integers(0, 600, 40000)
    follows = rng.permutation(600)
    number = np.where(rng.random(40000) < 0.9, follows[one], rng.integers(0, 600, 40000))
    p = log_bilinear.start(shape)
    for nth in range(4):
        p, times = log_bilinear.train(p, shape, log_bilinear.drawn(iter([(two, one, number)]), rng), rng, 0.1)
    some = np.repeat(np.arange(5), 600)
    logs = log_bilinear.log_probabilities(p, shape, two[some], one[some], np.tile(np.arange(600), 5))
    assert np.allclose(np.exp(logs).reshape(5, 600).sum(axis=1), 1, atol=1e-4)
    gain = log_bilinear.log_probabilities(p, shape, two[:3000], one[:3000], number[:3000]).mean() - np.log(1 / 600)
    assert gain > 1.0


def test_repeated_contexts_are_scored_once(monkeypatch):
    """Like contexts share one row of products with the classes, like tokens after them one within the class; scores are those of the dense model in double precision."""
    rng = np.random.default_rng(1)
    shape = log_bilinear.shape_of(np.sort(rng.zipf(1.3, 300).clip(1, 900))[::-1].astype(float))
    p = log_bilinear.start(shape)
    targets, classes, maps, _ = shape.rows
    p[:maps] += rng.normal(0, 0.2, (maps, log_bilinear.WIDTH + 1)).astype(np.float32)
    p[0] *= 40  # scores that single precision has no exponential of
    two, one, number = (np.tile(rng.integers(0, 300, 500), 20) for _ in range(3))
    shapes, picked = [], log_bilinear._picked
    monkeypatch.setattr(log_bilinear, "_picked", lambda scores, *places: (shapes.append(scores.shape), picked(scores, *places))[1])
    got = log_bilinear.log_probabilities(p, shape, two, one, number)
    of_classes = sum(n for n, wide in shapes if wide == maps - classes)
    assert of_classes == len(set(zip(two, one, strict=True))) and sum(n for n, _ in shapes) - of_classes <= len(set(zip(two, one, number, strict=True)))
    q, n = p.astype(float), log_bilinear.WIDTH
    r = np.concatenate([q[two[:500], :n] @ q[maps : maps + n, :n] + q[one[:500], :n] @ q[maps + n :, :n], np.ones((500, 1))], axis=1)
    log_sum = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
    for i, (w, v) in enumerate(zip(number[:500], r, strict=True)):
        c = shape.kind[w]
        all_classes, inside = q[classes:maps] @ v, q[targets + shape.bounds[c] : targets + shape.bounds[c + 1]] @ v
        assert got[i] == pytest.approx(all_classes[c] - log_sum(all_classes) + inside[w - shape.bounds[c]] - log_sum(inside), rel=1e-4, abs=1e-3)
    assert (got.reshape(20, 500) == got[:500]).all()


def test_places_are_those_of_a_search():
    """Head tokens and noise tokens are found as by a binary search, even or crowded, within, between and beyond all."""
    rng = np.random.default_rng(0)
    for hashes in (rng.integers(0, 1 << 64, 5000, np.uint64), np.arange(7, 9000, 3, dtype=np.uint64), np.array([(1 << 64) - 1], np.uint64), np.zeros(1, np.uint64)):
        head = log_bilinear.make_head(hashes, np.ones(len(hashes), np.int64))
        ask = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 1 << 64, 3000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        known, k = head.look(ask)
        assert (known == np.isin(ask, hashes)).all() and (head.hash[k[known]] == ask[known]).all()
    for share in (np.full(4000, 1 / 2000), np.append(1.0, np.full(3000, 1e-7)), np.ones(3)):
        upto = np.cumsum(share)
        begin = np.searchsorted(upto, np.arange(int(upto[-1] * log_bilinear.CELLS) + 2) / log_bilinear.CELLS, "right")
        x = np.concatenate([rng.random(5000) * upto[-1], upto])
        assert (log_bilinear.found(upto, begin, x) == np.searchsorted(upto, x, "right")).all()


def test_training_step_is_that_of_each_token(monkeypatch):
    """A step moves rows by the gradients of the batch's tokens and their noise, added up one by one in double precision."""
    monkeypatch.setattr(log_bilinear, "NOISE", 8)
    rng = np.random.default_rng(2)
    shape = log_bilinear.shape_of(np.sort(rng.zipf(1.3, 400).clip(1, 3000))[::-1].astype(float))
    p = log_bilinear.start(shape)
    targets, classes, maps, rows = shape.rows
    p[:maps] += rng.normal(0, 0.2, (maps, log_bilinear.WIDTH + 1)).astype(np.float32)
    two, one, number = rng.integers(0, 400, 700), rng.integers(0, 400, 700) % 50, rng.integers(0, 400, 700) % 90
    got, times = log_bilinear.train(p, shape, iter([(two, one, number)]), np.random.default_rng(5), 0.1)
    q, n, draw = p.astype(float), log_bilinear.WIDTH, np.random.default_rng(5)
    share, class_share = np.exp(shape.share), np.exp(shape.class_share)
    noise_classes = draw.choice(len(class_share), 8, p=class_share / class_share.sum())
    chance, upto = draw.random((700, log_bilinear.NOISE_WITHIN)), np.cumsum(share)
    gradient, seen = np.zeros(q.shape), np.zeros(rows)
    below = lambda x: 1 / (1 + np.exp(x))

    def add(row, g, often=1):
        gradient[row, : len(g)] += g
        seen[row] += often

    for c in noise_classes:
        add(classes + c, np.zeros(1))
    for i, j in enumerate(np.argsort(number, kind="stable")):
        a, b, w = two[j], one[j], number[j]
        c = shape.kind[w]
        r = np.append(q[a, :n] @ q[maps : maps + n, :n] + q[b, :n] @ q[maps + n :, :n], 1)
        terms = [(classes + c, below(r @ q[classes + c] - np.log(8) - shape.class_share[c]), 1)]
        terms += [(classes + x, -below(np.log(8) + shape.class_share[x] - r @ q[classes + x]), 0) for x in noise_classes]
        low, high = shape.bounds[c], shape.bounds[c + 1]
        if high - low > 1:
            level = np.log(log_bilinear.NOISE_WITHIN) + shape.share
            start = upto[low] - share[low]
            noise = np.clip(np.searchsorted(upto, start + chance[i] * (upto[high - 1] - start), "right"), low, high - 1)
            terms += [(targets + w, below(r @ q[targets + w] - level[w]), 1), *((targets + x, -below(level[x] - r @ q[targets + x]), 1) for x in noise)]
        back = sum(by * q[row, :n] for row, by, _ in terms)
        for row, by, often in terms:
            add(row, by * r, often)
        add(a, q[maps : maps + n, :n] @ back)
        add(b, q[maps + n :, :n] @ back)
        gradient[maps : maps + n, :n] += np.outer(q[a, :n], back) / np.sqrt(700)
        gradient[maps + n :, :n] += np.outer(q[b, :n], back) / np.sqrt(700)
    seen[maps:] = 1
    g = gradient / np.sqrt(np.maximum(seen, 1))[:, None]
    assert (times == seen).all() and np.abs(got - (q + 0.1 * g / np.sqrt(1e-3 + g * g))).max() < 1e-3


def test_draws_grow_with_the_tokens(monkeypatch):
    """Batches in proportion to all tokens, from every part; a few tokens are drawn again, none give none."""
    rng = np.random.default_rng(0)
    monkeypatch.setattr(log_bilinear, "BATCH", 64)
    monkeypatch.setattr(log_bilinear, "STEPS", 5)
    part = lambda i, n: (np.full(n, i),) * 3
    got = lambda *sizes: [x[0] for x in log_bilinear.drawn((part(i, n) for i, n in enumerate(sizes)), rng)]
    assert [len(x) for x in got(3)] == [64] * 5 and got() == []
    for times in (1, 3, 10):
        found = got(*[20000] * times)
        assert len(found) == times * -(-2000 // 64) and {int(i) for x in found for i in x} == set(range(times))


def test_every_training_token_is_learned_from(spark, monkeypatch):
    """Over all rounds a step is given each token of each document once, with its context, however tasks cut them; only a task of few tokens sees some again."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 50))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = docs.toArrow()
    h = np.concatenate([log_bilinear.words(c, log_bilinear.PLAIN_LOWER).hash for c in log_bilinear.chunks(whole["text"].combine_chunks())])
    head = log_bilinear.make_head(*np.unique(np.append(h, [log_bilinear.END] * 400), return_counts=True))
    shape = log_bilinear.shape_of(np.append(head.count[np.argsort(head.kind)], 0).astype(float))
    given = []
    monkeypatch.setattr(log_bilinear, "HELD", 1000)
    monkeypatch.setattr(log_bilinear, "BATCH", 64)
    monkeypatch.setattr(log_bilinear, "train", lambda p, shape, batches, rng, rate: (given.extend(batches), (p, np.zeros(len(p))))[1])
    shared = lambda: None
    shared.value = (head.hash, head.count, head.kind, log_bilinear.start(shape), (shape.tokens, shape.bounds, shape.kind, shape.class_share, shape.share))

    def learned(steps):
        given.clear()
        monkeypatch.setattr(log_bilinear, "STEPS", steps)
        for nth in range(log_bilinear.ROUNDS):
            list(log_bilinear._round(shared, nth)(iter(docs.where(log_bilinear.in_round(nth)).toArrow().to_batches(max_chunksize=30))))
        return np.stack([np.concatenate(x) for x in zip(*given, strict=True)], axis=1)

    want = np.stack([np.concatenate(x) for x in zip(*log_bilinear._held(iter(whole.to_batches()), head), strict=True)], axis=1)
    order = lambda x: x[np.lexsort(x.T)]
    assert len(want) == len(h) + 400 and (order(learned(0)) == order(want)).all()
    again = learned(200)
    assert len(again) > len(want) and (np.unique(again, axis=0) == np.unique(want, axis=0)).all()


def test_training_does_not_hold_a_whole_task(monkeypatch):
    """Parts of some HELD tokens together have all tokens of the batches, with their contexts."""
    text = pa.array([" ".join(f"w{(i * j) % 7}" for j in range(30)) for i in range(50)] + [None, ""])
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(range(26)), text.slice(at, 26)], ["doc_id", "text"]) for at in (0, 26)])
    h = log_bilinear.words(log_bilinear.chunks(text).__iter__().__next__(), log_bilinear.PLAIN_LOWER).hash
    head = log_bilinear.make_head(*np.unique(np.append(h, log_bilinear.END), return_counts=True))
    whole = list(log_bilinear._held(batches(), head))
    monkeypatch.setattr(log_bilinear, "HELD", 100)
    parts = list(log_bilinear._held(batches(), head))
    assert len(whole) == 1 and len(parts) > 1 and len(whole[0][0]) == 50 * 30 + 52
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole[0], strict=True))


def test_language_model_beats_the_base_on_held_out_text(spark):
    """Text of pairs that go together: held-out texts are likelier by the model than by shares of tokens."""
    rng = np.random.default_rng(0)
    pairs = [(f"a{i}", f"b{i}") for i in range(40)]
    rows = [(i, " ".join(x for k in rng.integers(0, 40, 60) for x in pairs[k])) for i in range(300)]
    got = log_bilinear.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out").collect()
    assert len(got) > 20 and sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def brute_kneser_ney(texts, order):
    """log10 P of a text by the textbook recursion, on the words of all texts."""
    cut = lambda t: re.findall(r"[a-z0-9\x80-\u07ff]+|[\u0800-\U0010ffff]|[^\sa-z0-9\x80-\U0010ffff]+", (t or "").translate(UP))
    padded = lambda t: ["<s>"] * (order - 1) + cut(t) + ["</s>"]
    spans = lambda w: (tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
    levels = [Counter(g for t in texts for g in spans(padded(t)))]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    words = {w for t in texts for w in cut(t)}
    stats = []
    for c in levels:
        n = [max(sum(v == k for v in c.values()), 1) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, *np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])]
        total, freed = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3)]
        stats.append((c, d, total, freed))

    def p(g):
        c, d, total, freed = stats[len(g) - 1]
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(words) + 2)
        if not total[g[:-1]]:
            return lower
        return (c[g] - d[min(c[g], 3)]) / total[g[:-1]] + freed[g[:-1]] / total[g[:-1]] * lower

    return lambda t: (len(cut(t)), sum(math.log10(p(g)) for g in spans([x if x in words or x in ("<s>", "</s>") else "<unk>" for x in padded(t)])))


@pytest.mark.parametrize("order,head", [(2, 1 << 20), (2, 30), (3, 1 << 20), (3, 30)])
def test_kneser_ney_against_brute_force(spark, texts, order, head, monkeypatch):
    """All scripts, nulls and repeated rows; n-grams looked up map-side and joined."""
    monkeypatch.setattr(kneser_ney, "HEAD", head)
    more = {200: "Привет, мир! Привет снова", 201: "你好世界 你好 世界", 202: "สวัสดี ชาวโลก สวัสดี", 203: "नमस्ते दुनिया नमस्ते", 204: "!!! *** w1 !!!", 205: "Zzz"}
    every = {**texts, **more}
    taught = [i for i in every if i % 3]
    rows = [(i, t, "en", None, 0) for i, t in every.items()]
    df = spark.createDataFrame(rows + [rows[-2]] * 2 + [(None, "w1 w2", None, None, 0)], DOCS).repartition(3)
    model = kneser_ney.train(df.where(F.col("doc_id").isin(taught)).dropDuplicates(["doc_id"]), order)
    brute = brute_kneser_ney([every[i] for i in taught], order)
    got = kneser_ney.perplexities(df, model).collect()
    assert Counter(r.doc_id for r in got) == Counter([*every, 204, 204, None])
    for r in got:
        n, logp = brute("w1 w2" if r.doc_id is None else every[r.doc_id])
        assert r.n_tokens == n and r.perplexity == pytest.approx(10 ** (-logp / (n + 1)) if n else 1.0)
    assert {r.lang for r in got if r.doc_id is None} == {None}


def test_kneser_ney_unknown_words_share(spark, monkeypatch):
    """With a vocabulary of a few words the others are one word, whose probability they share; all sum to one."""
    monkeypatch.setattr(kneser_ney, "VOCABULARY", 3)
    for name, value in (("UNKNOWN", 3), ("BEGIN", 4), ("END", 5)):
        monkeypatch.setattr(kneser_ney, name, value)
    df = spark.createDataFrame([(1, "a a a b b b c c c d e f g a b c d a b"), (2, "a b c a")], "doc_id long, text string")
    model = kneser_ney.train(df)
    assert len(model.vocabulary) == 3
    p = 10**model.word
    assert p[:3].sum() + p[3] * (4 + 1) + p[5] == pytest.approx(1)


def test_quality_rejects_noise(spark):
    rng = np.random.default_rng(0)
    good = [(i, " ".join(rng.choice(["some", "plain", "words", "of", "prose", "here"], 80)) + ".", "en", "s", 0) for i in range(30)]
    bad = [(100 + i, " ".join(rng.choice(["ZQX#!", "%%$KJ", "V@@W9"], 80)), "en", "s", 0) for i in range(5)]
    df = spark.createDataFrame(good + bad + [(200, None, None, None, None), (201, "", "xx", None, 0)], DOCS)
    marks = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.keep_good(df, marks).collect()}
    assert kept == {*range(30), 200, 201}
    assert kneser_ney.quality(df, marks.where("false")).where("not accepted").count() == 0


def test_quality_threshold_is_the_quantile(spark, monkeypatch):
    """Of enough trusted documents that aren't learned from; made-up words go."""
    rng = np.random.default_rng(1)
    vocabulary = ["some", "plain", "words", "of", "prose", "here", "and", "there"]
    rows = [(i, " ".join(rng.choice(vocabulary, 40)) + ".", "en" if i < 800 else "fr", "s", 0) for i in range(820)] + [(900, "Shti " * 40, "en", "s", 0)]
    marks = spark.createDataFrame([(i, 1, 0) for i in range(820)] + [(900, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.quality(spark.createDataFrame(rows, DOCS), marks).collect()}
    back = [i for i in range(820) if zlib.crc32(str(i).encode()) % 4 == 0]
    p, f = sorted(got[i].perplexity for i in back if i < 800), [got[i].perplexity for i in back if i >= 800]
    assert p[int(len(p) * 0.97)] <= got[0].threshold <= p[-1] and not got[900].accepted
    assert sum(not got[i].accepted for i in range(800)) <= 16
    assert got[810].threshold == pytest.approx(1.5 * max(f))


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(50)]
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        s = [" ".join(rng.choice(plain, 8)) for _ in range(6)]
        if bad:
            s[i % 6] += " Nasty! vile"
        rows.append((i, ". ".join(s) + ".", "en", "s", 0))
        marks.append((i, 1, int(bad)))
    df, marks = spark.createDataFrame([*rows, (900, None, None, None, None), (None, "x", None, None, 1)], DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(df, marks).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(300)) and got[900].predicted == 0
    assert b"asty" in rows[4][1].encode()[got[4].worst_begin : got[4].worst_end] or b"vile" in rows[4][1].encode()[got[4].worst_begin : got[4].worst_end + 6]
    for i in range(300):
        spans = [rows[i][1].encode()[x.begin : x.end].lower() for x in got[i].offending]
        assert (len(spans) > 0 and all(b"asty" in x or b"vile" in x for x in spans)) if i % 4 == 0 else not spans
    assert {r.score for r in toxicity.scores(df, marks.where("false")).collect()} == {0.0}


def test_mixing_against_dense_solution(docs, labels):
    rows = mixing.rates(docs, labels, {"q1t0": 0.5, "q0t0": 0.5}, pull=0.1, steps=80).collect()
    p, u = np.array([r.posteriors for r in rows]), np.array([r.tokens for r in rows], float)
    u /= u.sum()
    t = np.array([{"q1t0": 0.5, "q0t0": 0.5}.get(d, 0) for d in rows[0].domains])
    x = np.ones(len(u))
    for _ in range(5000):
        x = np.maximum(0, x - (p @ (p.T @ (u * x) - t) + 0.1 * (x - 1)) / 1.1)
    assert np.allclose([r.rate for r, w in zip(rows, u, strict=True)], x, atol=1e-3)


def test_mixing_reaches_its_targets(spark):
    """Totals of small domains too, at soft memberships, with the default pull and steps."""
    rng = np.random.default_rng(4)
    shares, target = np.array([0.751, 0.105, 0.129, 0.015]), np.array([0.9, 0.04, 0.05, 0.01])
    p = 0.9 * np.eye(4)[rng.choice(4, 3000, p=shares)] + 0.1 * shares
    u = rng.integers(50, 500, 3000)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(u, p, strict=True)], "tokens long, posteriors array<double>").coalesce(2).cache()
    x = mixing.rates_at(p, mixing.solve(rows, 4, target))
    assert np.allclose((u * x) @ p / u.sum() / target, 1, atol=0.01)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, nulls in any column, and further columns whose names clash with those added or used inside."""
    shared = " ".join(f"token{i}" for i in range(20))
    rows = [(1, shared + "\nfirst line of all", "en", "s", 9)] * 3 + [(2, shared, None, None, None), (3, None, None, None, None), (None, shared, "en", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("rate", "copies", "fp", "key", "parts", "perplexity", "n_lines", "component_id", "hits", "item", "n", "a", "b", "m", "score", "_good", "_bad", "tokens", "id"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(2)


def test_repeated_rows_nulls_and_clashing_names(spark, odd):
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    tests = spark.createDataFrame([(7, " ".join(f"token{i}" for i in range(5, 16))), (7, None), (8, "first line")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    every, named = [(False, 1)] * 3 + [(False, 2), (False, 3), (True, 0), (True, 0)], [(False, 1)] * 3 + [(False, 2), (False, 3)]
    for made in (license_scan.scan(odd), toxicity.scores(odd, marks), log_bilinear.scores(odd), kneser_ney.quality(odd, marks), mixing.rates(odd, marks)):
        assert ids(made) == every
    for made in (rlz_dedup.dedup_substrings(odd), line_dedup.line_report(odd), simhash.near_components(odd)):
        assert ids(made) == named
    for block in (1 << 20, 30):
        got = positional_index.search(odd, tests, block_bytes=block)
        assert ids(got) == every
        assert sorted((r.doc_id or 0, len(r.hits), len(r.items)) for r in got.collect()) == [(0, 0, 0), (0, 11, 1), (1, 13, 2), (1, 13, 2), (1, 13, 2), (2, 11, 1), (3, 0, 0)]
    for made in (kneser_ney.keep_good(odd, marks), line_dedup.dedup_lines(odd), simhash.one_of_each(odd), mixing.mix(odd, marks)):
        assert len(set(made.columns)) == len(made.columns) and made.count() >= 0


def test_neighbours_of_repeated_ids(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(4, [4.0, 1.0])] * 20 + [(6, [4.0 + k / 100, 1.0]) for k in range(15)]
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2), F.col("id") == 5, share=1.0)
    assert sorted((r.rank, r.vec_id) for r in got.collect()) == list(enumerate([6, 4, 3, 7, 2, 8, 1, 9, 10, 11], 1))


def test_empty_tables(empty, labels, spark):
    tests = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for made in (
        rlz_dedup.dedup_substrings(empty), line_dedup.line_report(empty), simhash.near_components(empty), positional_index.contamination(empty, tests),
        license_scan.scan(empty), log_bilinear.scores(empty), kneser_ney.quality(empty, labels), toxicity.scores(empty, labels), mixing.rates(empty, labels),
    ):
        assert made.count() == 0


def test_pipeline(spark, tmp_path, docs, labels):
    root = f"file://{tmp_path}"
    docs.write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "apache license")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    out = corpus_pipeline.run(spark, root)
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 68 not in ids and 61 not in ids
    assert {"rate", "copies"} <= set(out.columns)


def test_pipeline_on_odd_tables(spark, tmp_path, odd, empty):
    """Repeated rows, nulls, clashing columns; then empty tables."""
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("rate", F.lit("x"))
    tests = spark.createDataFrame([(9, "no such words"), (None, "first line"), (10, None)], "item_id long, text string")
    for name, docs, labels, items in (("a", odd, marks, tests), ("b", empty, marks.where("false"), tests.where("false"))):
        root = f"file://{tmp_path}/{name}"
        docs.write.parquet(f"{root}/documents.parquet")
        labels.write.parquet(f"{root}/labels.parquet")
        items.write.parquet(f"{root}/benchmark.parquet")
        got = corpus_pipeline.run(spark, root)
        assert got.columns == [*corpus_pipeline.COLUMNS, "rate", "copies"]
        ids = [r.doc_id for r in got.collect()]
        assert set(ids) <= {1, 2, 3} and ids.count(1) in (0, 3) and (name == "a") == bool(ids)


ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def here(_):
    try:
        import tidemark
        return [1]
    except ImportError:
        return [0]

assert spark.sparkContext.parallelize([1], 1).mapPartitions(here).collect() == [0]
from tidemark.llm.queries import QUERIES
for name, query in QUERIES.items():
    print(name, query(spark, {tables!r}).count())
import corpus_pipeline
print("pipeline", corpus_pipeline.run(spark, {tables!r}).count())
"""


def test_workers_need_not_have_the_package(tmp_path):
    """All queries, where workers can't import the package."""
    tables, root = "/root/testdata/sf0.001", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if not os.path.isdir(tables):
        pytest.skip("no test tables")
    script = tmp_path / "alone.py"
    script.write_text(ALONE.format(root=root, tables=tables))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 28


def test_quality_tells_a_null_text_from_a_null_language(spark):
    """Rows of one id, one with a text and no language, one with that text as its language and no text, are scored apart."""
    rows = [(i, "some words that are trusted here", "en", None, None) for i in range(40)] + [(99, "words", None, None, None), (99, None, "words", None, None)]
    good = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality(spark.createDataFrame(rows, DOCS), good).where("doc_id = 99").collect()
    assert sorted((r.lang or "", r.n_tokens) for r in got) == [("", 1), ("words", 0)]
