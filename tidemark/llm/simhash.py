"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits come from the XXH64 hashes of word shingles. Only
distinct fingerprints are compared. By the pigeonhole principle two that
differ in at most ``radius`` bits agree wholly in 2 of ``radius + 2`` bit blocks,
so each fingerprint is dealt under every choice of two blocks. The fingerprints
of all deals of a batch, large or small, are stored as 64 vertical bit planes;
one XOR of a plane compares 64 fingerprints at once, carry-save counters add
the differing bits of all lanes, and a block of lanes is abandoned when every
counter exceeds the radius.

By Jaccard similarity (``similar_components``) fingerprints have 256 bits, whose
distance tells 0.8 from lower similarities far better than 64 bits do. Deals go
by random choices of bits; the planes of the first word sieve, and what is left
is compared on all words. The links found are checked on the shingles
themselves, and then every candidate between the pieces that checked links
leave apart. This form has a stated recall, not a full one.

A deal of more than TILE fingerprints is dealt once more by its other bits; what
is still larger is cut into tiles and compared tile by tile, in tasks of their
own, so one very common block value never meets in one task. Inside a tile only the links that join separate pieces are passed on (by
Jaccard similarity, in the first of two passes): the components stay whole and
a group of g near copies sends fewer than g links. Components are found by contraction (graph.py).

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; a document shorter than a shingle is one shingle; rows without
doc_id are left out, as they cannot be named; repeated rows are answered once
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import lists
from .frequent import join_hot
from .graph import components
from .scratch import discard, keep

SEED = 42
TILE = 4096
LANES = 64
#: Cells of one query and one word of lanes that are compared at once.
CELLS = 1 << 14
#: Pairs that are passed on at once, or little more.
SENT = 1 << 16
#: Words of a wide fingerprint, and the names of those after the first.
WORDS = 4
FURTHER = ["f1", "f2", "f3"]


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none of a blank text."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(len(gaps) + 2 - width, 1)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)][:n]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """Bits set in over half of the shingles' hashes, as an unsigned integer."""
    return majority(shingle_hashes(text, width))


def wide_fingerprint(text: bytes, width: int) -> list[int]:
    """WORDS words: the fingerprint, and the majorities of the distinct hashes mixed once more for each further word."""
    hashes = np.unique(shingle_hashes(text, width))
    return [majority(hashes), *(majority(mixed(hashes, k)) for k in range(1, WORDS))]


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        piece = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint((x or "").encode(), width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return docs.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """Bit masks of which at least one finds any two fingerprints within the radius equal."""
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, 2)]


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of machine words: bit j of word i in row b is bit b of fingerprint 64*i + j."""
    n = -(-len(fps) // LANES) * LANES
    padded = np.zeros(n, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, sliced: np.ndarray, radius: int, query: np.ndarray | None = None, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) where the lane's fingerprint differs from the query's in at most ``radius`` bits.

    A cell is one query against one machine word of lanes (all of them, or those given by ``query`` and ``word``);
    cells whose lanes all exceed the radius are abandoned.
    """
    digits = radius.bit_length() + 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    if query is None:
        query, word = np.repeat(np.arange(len(queries)), sliced.shape[1]), np.tile(np.arange(sliced.shape[1]), len(queries))
    count = np.zeros((digits, len(query)), np.uint64)
    over = np.zeros(len(query), np.uint64)
    limit = radius + 1
    for b in range(64):
        flip = -(queries >> np.uint64(b) & np.uint64(1))
        carry = sliced[b, word] ^ flip[query]
        for d in range(digits):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over |= carry
        if b >= radius and (b & 3 == 3 or b == 63):
            above = np.full(len(query), full)
            for d in range(digits):
                above = (count[d] & above) if limit >> d & 1 else (count[d] | above)
            over |= above
            stay = over != full
            if not stay.all():
                query, word, over, count = query[stay], word[stay], over[stay], count[:, stay]
            if not len(query):
                return query, word
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(lanes)
    return query[cell], word[cell] * LANES + lane


def pairs_within(fps: np.ndarray, bounds: np.ndarray, side: np.ndarray, radius: int):
    """Pairs (i, j), i < j, of one deal that differ in at most ``radius`` bits, in blocks. Deals lie between ``bounds``.

    All deals share one set of planes, whatever their sizes; a row is compared
    with the machine words that hold the later rows of its deal. Of a deal of two
    sides, rows of side 1 come first and meet rows of side 2 only.
    """
    sliced = planes(fps)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    asking = np.flatnonzero((np.arange(len(fps)) + 1 < stop) & (side <= 1))
    first = (asking + 1) >> 6
    cells = ((stop[asking] - 1) >> 6) - first + 1
    upto = np.cumsum(cells)
    at = 0
    while at < len(asking):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
        some, n = asking[at:to], cells[at:to]
        query = np.repeat(np.arange(len(some)), n)
        word = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        q, j = within(fps[some], sliced, radius, query, word)
        i = some[q]
        good = (j > i) & (j < stop[i])
        i, j = i[good], j[good]
        good = (side[i] == 0) | (side[j] == 2)
        yield i[good], j[good]
        at = to


class Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def joining(forest: Forest, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs, in order, that join pieces of the forest."""
    nodes = np.unique(np.concatenate([i, j]))
    roots = np.array([forest.root(k) for k in nodes.tolist()], np.int64)
    new = roots[np.searchsorted(nodes, i)] != roots[np.searchsorted(nodes, j)]
    return [pair for pair in zip(i[new].tolist(), j[new].tolist(), strict=True) if forest.join(*pair)]


def _compare(radius: int, most: int = 0, apart: bool = False):
    """Rows sorted by (deal, key, tile, side): fp, id, key, tile, side, deal, further words. Side 0: both sides of the tile.

    ``most``: further words are compared too, and pairs differ in at most so many bits in all.
    ``apart``: the last column is the piece a row belongs to, and all pairs of different pieces are passed on.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def send(pairs):
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=schema)

    def work(rows):
        key = rows[:, [2, 3, 5]]
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(rows)]]))
        rows = rows[np.repeat(sizes > 1, sizes)]
        if not len(rows):
            return
        bounds = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
        fps, ids, further = rows[:, 0].copy().view(np.uint64), rows[:, 1], np.ascontiguousarray(rows[:, 6:])
        piece = further[:, -1] if apart else None
        further = np.ascontiguousarray(further[:, :-1] if apart else further).view(np.uint64)
        forest, out, n = Forest(len(rows)), [], 0
        for i, j in pairs_within(fps, bounds, rows[:, 4], radius):
            if most:
                far = np.bitwise_count(fps[i] ^ fps[j]) + np.bitwise_count(further[i] ^ further[j]).sum(axis=1, dtype=np.int64)
                # Close pairs first, so that what joins two pieces is about the closest pair of them.
                near = np.argsort(far, kind="stable")
                near = near[: np.searchsorted(far[near], most, "right")]
                i, j = i[near], j[near]
            if apart:
                new = piece[i] != piece[j]
                pairs = np.stack([i[new], j[new]], axis=1)
            else:
                pairs = np.array(joining(forest, i, j), np.int64).reshape(-1, 2)
            out.append(ids[pairs])
            n += len(pairs)
            if n >= SENT:
                yield send(np.concatenate(out))
                out, n = [], 0
        if n:
            yield send(np.concatenate(out))

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            same = (rows[:, [2, 3, 5]] == rows[-1, [2, 3, 5]]).all(axis=1)
            tail = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [rows[tail:]]
            if tail:
                yield from work(rows[:tail])
        if held:
            yield from work(held[0])

    return run


def near_links(reps: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): ids of distinct fingerprints within the radius, enough to give whole components. reps: fp, id.

    A deal of more than ``tile`` is dealt once more: its fingerprints differ in
    the other bits only, so two within the radius agree in one of radius + 1 parts of these.
    """
    chosen = masks(radius)
    deals = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(chosen)])
    dealt = reps.select("fp", "id", F.explode(deals).alias("d")).select("fp", "id", "d.m", "d.key")
    crowded = dealt.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("m", "key", F.lit(True).alias("_crowded"))
    parts = F.array(*[F.array(*[F.lit(_signed(x)) for x in rest_of(m, radius + 1)]) for m in chosen])
    again = F.transform(F.get(parts, F.col("m")), lambda x, i: F.struct((F.col("m") + (i + 1) * len(chosen)).cast("int").alias("m"), F.xxhash64("key", F.col("fp").bitwiseAND(x)).alias("key")))
    once = F.array(F.struct("m", "key"))
    dealt = dealt.join(crowded, ["m", "key"], "left").select("fp", "id", F.explode(F.when(F.col("_crowded"), again).otherwise(once)).alias("d"))
    return _compared(dealt.select("fp", "id", "d.m", "d.key"), [], _compare(radius), tile)


def rest_of(mask: int, parts: int) -> list[int]:
    """The bits that are not in the mask, cut in parts."""
    bits = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _compared(dealt: DataFrame, further: list[str], compare, tile: int) -> DataFrame:
    """Deals (fp, id, m, key and further words), compared tile by tile."""
    crowded = dealt.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    parts = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    dealt = (
        dealt.join(crowded.select("m", "key", parts.alias("parts")), ["m", "key"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    )
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = dealt.withColumn("other", F.explode(other)).select(
        "fp",
        "id",
        "key",
        (F.least("own", "other") * 65536 + F.greatest("own", "other")).alias("tile"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "m",
        *further,
    )
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "m", "key", "tile").sortWithinPartitions("m", "key", "tile", "side")
    return dealt.mapInArrow(compare, "a long, b long")


def wide_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp, f1, f2, f3): 256 bits; the further words are majorities over mixed hashes."""

    def run(batches):
        for batch in batches:
            made = np.array([wide_fingerprint((x or "").encode(), width) for x in batch.column(1).to_pylist()], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k].copy()) for k in range(WORDS))], ["doc_id", "fp", *FURTHER])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return docs.mapInArrow(run, "doc_id long, fp long, " + ", ".join(f"{c} long" for c in FURTHER))


def similar_links(reps: DataFrame, n: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b) as near_links gives them, of wide fingerprints. reps: n rows of fp, f1, f2, f3, id.

    If reps has a column ``piece``, all pairs of different pieces are given, not
    only those that join the pieces of a tile.

    Two shingle sets of Jaccard similarity s have cosine 2s/(1+s), and differ in
    a bit with probability p = angle/pi. Links differ in at most the bits that
    nine tenths of the pairs at the given similarity do. Each deal takes as key
    some bits drawn at random, as many as leave at most about 256 of n rows a
    key, and there are so many deals that such a pair meets in one with
    probability 0.95, at any n.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * WORDS
    most = round(bits * p + 1.28 * np.sqrt(bits * p * (1 - p)))
    radius = round(64 * p + 3 * np.sqrt(64 * p * (1 - p)))
    chosen = max(14, int(np.ceil(np.log2(max(n, 1)))) - 8)
    deals = int(np.ceil(3 / (1 - p) ** chosen))
    rng = np.random.default_rng(SEED)
    rows = []
    for m in range(deals):
        words = [0] * WORDS
        for bit in rng.choice(bits, chosen, replace=False).tolist():
            words[bit >> 6] |= 1 << (bit & 63)
        rows.append(F.struct(F.lit(m).alias("m"), *[F.lit(_signed(x)).alias(f"w{k}") for k, x in enumerate(words)]))
    names = ["fp", *FURTHER]
    piece = [c for c in reps.columns if c == "piece"]
    key = F.xxhash64(*[F.col(c).bitwiseAND(F.col(f"d.w{k}")) for k, c in enumerate(names)])
    dealt = reps.select(*names, *piece, "id", F.explode(F.array(*rows)).alias("d")).select(*names, *piece, "id", "d.m", key.alias("key"))
    return _compared(dealt, FURTHER + piece, _compare(radius, most, bool(piece)), tile)


def near_components(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    made = keep(fingerprints(docs, width), "fingerprints")
    reps = keep(made.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    roots = components(near_links(reps.select("fp", "id"), radius))
    classes = reps.join(roots, "id", "left").select("fp", "n", F.coalesce("root", "id").alias("component_id"))
    return join_hot(made, keep(classes, "components"), ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): the distinct shingles of each text, as 32 bits of their hashes."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes((x or "").encode(), width).astype(np.uint32)).view(np.int32) for x in batch.column(1).to_pylist()]
            values = np.concatenate([np.zeros(0, np.int32), *sets])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(values, np.array([len(x) for x in sets], np.int64), pa.int32())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<int>")


def verified(docs: DataFrame, found: DataFrame, similarity: float, width: int) -> DataFrame:
    """The links (a, b) whose texts have the Jaccard similarity of shingle sets, or more, as a kept table. Only the texts of linked rows are cut."""
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = shingle_sets(texts.join(ids, "id", "left_semi"), width).dropDuplicates(["id"])
    sets = keep(sets, "shingles")
    both = found.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    links = keep(both.where(same >= F.lit(similarity) * (F.size("sa") + F.size("sb") - same)).select("a", "b"), "links")
    discard(sets)
    return links


def similar_components(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, component_id: documents joined by links of the given Jaccard similarity of shingles, or more.

    The first pass checks only candidates that join pieces, which makes one piece
    of a group of close copies. A candidate that fails may have stood in for one
    that holds, so the second checks every candidate between different pieces.
    """
    names = ["fp", *FURTHER]
    made = keep(wide_fingerprints(docs, width), "fingerprints")
    sized = keep(made.groupBy(*names).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    reps, n = sized.drop("n"), sized.count()

    def checked(rows: DataFrame) -> DataFrame:
        pairs = similar_links(rows, n, similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = keep(pairs.distinct(), "candidates")
        links = verified(docs, pairs, similarity, width)
        discard(pairs)
        return links

    first = checked(reps)
    pieces = keep(reps.join(components(first), "id", "left").select(*names, "id", F.coalesce("root", "id").alias("piece")), "pieces")
    roots = components(first.unionByName(checked(pieces)))
    classes = sized.join(roots, "id", "left").select(*names, "n", F.coalesce("root", "id").alias("component_id"))
    return join_hot(made, keep(classes, "components"), names, "n").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The documents that are the smallest doc_id of their component, columns unchanged."""
    found = similar_components(docs, similarity, width).where("doc_id = component_id").select(F.col("doc_id").alias("_tm_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["_tm_id"], "left_semi")
