"""The Merkle manifest against a tree built in memory."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        first = i // 16 * 16
        out.append((nodes[first:i], nodes[i + 1 : first + 16]))
        i //= 16
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda x: x[0])
    trees = {s: tree([k[2] for k, _ in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, ((_, _, own), r) in enumerate(groups[s]):
            way, changed = siblings(trees[s], i) + siblings(top, n), list(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                changed[4] = r[4].translate(LOWER)
            node = leaf(changed)
            for left, right in way:
                node = digest(*left, node, *right)
            proof = digest(*(x for left, right in way for x in left + right))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def both(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("leaf", "g", "id", "rank")}).repartition(3)
    return sorted(map(tuple, merkle.report(docs).collect()), key=str), brute(rows)


def test_three_levels(spark):
    """A hot source, sources of a few rows, nulls in every column, letters that are not ASCII."""
    got, want = both(spark, [(i * 7, "a" if i % 3 else f"s{i % 40}é", None if i % 5 else "en", i, f"Text {i} É" if i % 11 else None) for i in range(700)])
    assert got == want and {r[-1] for r in got} == {True, False}


def test_odd_rows(spark):
    """Null and extreme ids, repeated rows, ids with several texts, null and empty sources, an empty and a very long text."""
    rng = random.Random(3)
    ids = [None, 5, 6, -(2**63), 2**63 - 1]
    rows = [(rng.choice([*ids, rng.randrange(-(2**63), 2**63)]), rng.choice([None, "", "a", "é", "z"]), None, rng.choice([None, -3]), rng.choice([None, "", "Ab"])) for _ in range(150)]
    got, want = both(spark, [*rows, (1, "long", "x", 1, "Long " * 200_000)])
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, "x", None, None, "T")], [(i, f"q{i}", "e", 1, "T") for i in range(20)]])
def test_small_tables(spark, rows):
    got, want = both(spark, rows) if rows else (merkle.report(spark.createDataFrame([], SCHEMA)).collect(), [])
    assert got == want


def test_crowded_cells(spark, monkeypatch):
    """One id on a third of the rows, some with the same text, some not: its cell is counted by leaf digits, its copies written in parts."""
    monkeypatch.setattr(merkle, "CROWD", 20)
    monkeypatch.setattr(merkle, "COPIES", 8)
    rng = random.Random(5)
    got, want = both(spark, [(rng.choice([4, 4, rng.randrange(9000)]), rng.choice([None, "a"]), None, None, rng.choice(["Same", f"T{i}"])) for i in range(400)])
    assert got == want


def test_proofs_alone(spark):
    """Siblings fold to the root; with other columns, groups and fan-out too."""
    docs = spark.createDataFrame([(i, i % 2, f"v{i}") for i in range(11)], "k long, part int, v string")
    found = merkle.proofs(docs, fields=("k", "v"), id_col="k", group_col="part", fanout=3).withColumn("again", merkle.folded(F.col("leaf"), F.col("siblings"))).collect()
    assert len(found) == 11 and all(r.again == r.root and r.changed == r.leaf for r in found)
    assert max(len(r.siblings) for r in found) == 3 and {r.source for r in found} == {"0", "1"}
    other = merkle.proofs(docs.withColumn("v", F.when(F.col("k") == 3, "other").otherwise(F.col("v"))), fields=("k", "v"), id_col="k", group_col="part", fanout=3).first()
    assert other.root != found[0].root
