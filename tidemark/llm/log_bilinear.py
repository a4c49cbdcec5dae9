"""Language-model scoring with a log-bilinear neural model.

Tokens are counted over all training documents. The VOCABULARY most frequent
have an embedding each; all others are one token, which adds its smoothed
unigram share where it is predicted. A prediction vector is the sum of the two
tokens before, each mapped by a matrix of its position. The next token is
predicted in two steps, its class (tokens of like frequency; all classes are
about equally frequent) and itself within the class, so that batched matrix
products give log-probabilities normalised over all tokens; those of a context
that stands again nearby are worked out once.

Training is by noise-contrastive estimation in numpy, in ROUNDS rounds. Each has
its share of the training documents, and all of these are in one of them, so that
every training token is learned from. In a round every task goes on from the model
so far. It takes its part of the documents as it comes, HELD tokens at a time, and
visits each token of them once, in random order; a task of few tokens draws from
them again, up to STEPS batches. The next model is the mean of the tasks' rows,
weighted by how often a task has trained a row, which Spark sums.

Counts of the HEAD most frequent tokens are broadcast (16 bytes each). Counts
of the others are joined: what a document has of them is grouped first, and no
such token is frequent enough to make a hot key.

Tokens are known by 64-bit hashes.

Defined results: a null or empty text has one token, its end; a null doc_id is
scored, with held_out null, and not learned from; repeated rows are scored (and
counted) once each; without training documents all counts are zero and the
model is uniform; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import PLAIN_LOWER, chunks, lists, words
from .frequent import frequent, tallies, unique_sums
from .scratch import discard, keep

#: Tokens that have an embedding, at most; classes of them; numbers in an embedding.
VOCABULARY = 1 << 14
CLASSES = 128
WIDTH = 24
HEAD = 1 << 17
#: Training: rounds, tokens in a batch, noise classes of a batch and noise tokens of a token.
ROUNDS, BATCH, NOISE, NOISE_WITHIN = 3, 4096, 32, 4
#: Draws for each token where a task draws again, and batches that a task takes in a round at least.
DRAWS, STEPS = 0.1, 60
#: Hash of the text end; no byte string.
END = np.uint64(0x7FFFFFFFFFFFFFFE)
HELD = 1 << 22
#: Tokens that are scored at once, at most (three numbers and a place share 63 bits), and bytes of text with about as many.
SCORE_AT_ONCE, SCORED_BYTES = 1 << 18, 3 << 19
#: Contexts of these whose products with all classes stay in a core's cache.
IN_CACHE = 1 << 11
#: Scores up to this have exponentials and sums of them within single precision.
PLAIN_EXP = 60
#: Cells of a class in a table that says where the search of a noise token begins.
CELLS = 1 << 11
#: Gradients of a row that are added one by one; more are summed at once.
FEW = 12


def held_out(folds: int = 7, fold: int = 2):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def in_round(nth: int):
    """Whether a document is learned from in a round; each is in one."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == nth


def _count_tokens(batches):
    def send(held):
        h, n = unique_sums(np.concatenate(held))
        yield from tallies(h.view(np.int64), n, ("h", "n"))

    held, n = [], 0
    for batch in batches:
        held.append(np.full(batch.num_rows, END, np.uint64))
        for c in chunks(batch.column(1)):
            held.append(words(c, PLAIN_LOWER).hash)
            n += len(held[-1])
        if n > HELD:
            yield from send(held)
            held, n = [], 0
    if held:
        yield from send(held)


@dataclass
class Head:
    """The most frequent tokens by hash, their counts, and the number of each in the model."""

    hash: np.ndarray
    count: np.ndarray
    kind: np.ndarray

    def __post_init__(self) -> None:
        # Hashes are even, so their first bits say about where one is.
        self.shift = np.uint64(64 - max(len(self.hash).bit_length(), 1))
        self.begin = np.searchsorted(self.hash, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, place) of each hash."""
        if not len(self.hash):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        last = len(self.hash) - 1
        k = np.minimum(self.begin[(h >> self.shift).astype(np.int64)], last)
        at = self.hash[k]
        for _ in range(2):
            on = np.flatnonzero(at < h)
            k[on] = np.minimum(k[on] + 1, last)
            at[on] = self.hash[k[on]]
        on = np.flatnonzero(at < h)
        k[on] = np.minimum(np.searchsorted(self.hash, h[on]), last)
        at[on] = self.hash[k[on]]
        return at == h, k


def make_head(hashes: np.ndarray, counts: np.ndarray) -> Head:
    """The VOCABULARY most frequent are numbered by falling count (ties by hash); the others share the number after the last."""
    order = np.lexsort((hashes, -counts))
    named = min(len(order), VOCABULARY)
    kind = np.full(len(hashes), named, np.int64)
    kind[order[:named]] = np.arange(named)
    order = np.argsort(hashes)
    return Head(hashes[order], counts[order], kind[order])


def sequence(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows of a chunk with an end after each, and where each row's tokens begin."""
    n = np.diff(rows) + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.full(begin[-1], END, np.uint64)
    stay = np.ones(len(out), bool)
    stay[begin[1:] - 1] = False
    out[stay] = hashes
    return out, begin


def numbered(chunk, head: Head) -> tuple[np.ndarray, ...]:
    """(hashes, first token of each row, known, place in the head, number, number before, number before that)."""
    w = words(chunk, PLAIN_LOWER)
    h, begin = sequence(w.hash, w.rows)
    known, k = head.look(h)
    others = min(len(head.hash), VOCABULARY)
    number = np.where(known, head.kind[k], others) if len(head.kind) else np.zeros(len(h), np.int64)
    known_end, at = head.look(np.array([END]))
    end = int(head.kind[at[0]]) if known_end[0] else others
    one, two = np.roll(number, 1), np.roll(number, 2)
    first = begin[:-1]
    one[first] = two[first] = end
    two[first[np.diff(begin) > 1] + 1] = end
    return h, begin, known, k, number, one, two


@dataclass
class Shape:
    """Where the rows of a model lie, the class of each token, and log shares of classes and of tokens in their class."""

    tokens: int
    bounds: np.ndarray
    kind: np.ndarray
    class_share: np.ndarray
    share: np.ndarray

    @property
    def rows(self) -> tuple[int, int, int, int]:
        """First row of the targets, of the classes, of the two maps, and the number of rows; before them are the contexts."""
        n, k = self.tokens, len(self.bounds) - 1
        return n, 2 * n, 2 * n + k, 2 * n + k + 2 * WIDTH


def shape_of(counts: np.ndarray) -> Shape:
    """Classes of about equal mass from smoothed counts by number; the last number, all other tokens, is a class of its own."""
    mass = counts + 0.5
    named = len(counts) - 1
    upto = np.cumsum(mass[:named])
    slot = np.minimum(((upto - mass[:named] / 2) / max(upto[-1] if named else 1, 1e-9) * (CLASSES - 1)).astype(int), CLASSES - 2)
    first = np.flatnonzero(np.diff(slot, prepend=-1)) if named else np.zeros(0, int)
    bounds = np.concatenate([first, [named, named + 1]]) if named else np.array([0, 1])
    kind = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    of_class = np.add.reduceat(mass, bounds[:-1])
    return Shape(len(counts), bounds, kind, np.log(of_class / of_class.sum()), np.log(mass / of_class[kind]))


def start(shape: Shape, seed: int = 7) -> np.ndarray:
    """A model that predicts the shares: rows of WIDTH numbers and a bias."""
    rng = np.random.default_rng(seed)
    targets, classes, maps, rows = shape.rows
    p = np.zeros((rows, WIDTH + 1), np.float32)
    p[:targets, :WIDTH] = rng.normal(0, 0.3, (targets, WIDTH))
    p[targets:maps, :WIDTH] = rng.normal(0, 0.03, (maps - targets, WIDTH))
    p[targets:classes, WIDTH] = shape.share
    p[classes:maps, WIDTH] = shape.class_share
    p[maps:, :WIDTH] = np.concatenate([np.eye(WIDTH) * 0.3, np.eye(WIDTH) * 0.7])
    return p


def embedded(p: np.ndarray, two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Rows of two contexts each, side by side with their unused last numbers."""
    return np.take(p, np.stack([two, one], axis=1), axis=0).reshape(len(one), -1)


def both_maps(p: np.ndarray, shape: Shape) -> np.ndarray:
    """The two maps, one above the other, as ``embedded`` rows are laid out."""
    maps = shape.rows[2]
    out = np.zeros((2, WIDTH + 1, WIDTH), np.float32)
    out[:, :WIDTH] = p[maps:, :WIDTH].reshape(2, WIDTH, WIDTH)
    return out.reshape(-1, WIDTH)


def near(contexts: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Prediction vectors of embedded contexts, with a one for the bias."""
    out = np.ones((len(contexts), WIDTH + 1), np.float32)
    out[:, :WIDTH] = contexts @ maps
    return out


def log_probabilities(p: np.ndarray, shape: Shape, two: np.ndarray, one: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Natural log of P(number | two, one), normalised over all numbers; worked out once where a context, or a token in it, stands again."""
    targets, classes, maps, _ = shape.rows
    out = np.empty(len(number), np.float64)
    bits = shape.tokens.bit_length()
    most = min(SCORE_AT_ONCE, 1 << (63 - 3 * bits))
    for at in range(0, len(number), most):
        some = slice(at, at + most)
        # Sorted by context, then token; the low bits say where it stands.
        key = two[some].astype(np.int64)
        for x in (one[some], number[some]):
            key <<= bits
            key |= x
        key *= most
        key += np.arange(len(key))
        key.sort()
        place = key & (most - 1)
        key //= most
        new = np.concatenate([[True], key[1:] != key[:-1]])
        key = key[new]
        w, context = key & ((1 << bits) - 1), key >> bits
        kind = shape.kind[w]
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(context))))
        context = context[begin]
        r = near(embedded(p, context >> bits, context & ((1 << bits) - 1)), both_maps(p, shape))
        got = np.empty(len(w), np.float32)
        for i in range(0, len(r), IN_CACHE):
            mine = slice(begin[i], begin[i + IN_CACHE] if i + IN_CACHE < len(r) else len(w))
            got[mine] = _picked(r[i : i + IN_CACHE] @ p[classes:maps].T, of[mine] - i, kind[mine])
        order = _sorted(kind, len(shape.bounds))
        cuts = np.searchsorted(kind[order], np.arange(len(shape.bounds)))
        for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(shape.bounds) > 1)).tolist():
            low, high = shape.bounds[c], shape.bounds[c + 1]
            mine = order[cuts[c] : cuts[c + 1]]
            got[mine] += _picked(np.take(r, of[mine], axis=0) @ p[targets + low : targets + high].T, np.arange(len(mine)), w[mine] - low)
        every = np.empty(len(place), np.float32)
        every[place] = got[np.cumsum(new) - 1]
        out[some] = every
    return out


def _picked(scores: np.ndarray, row: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log of the softmax of rows at a column each. ``scores`` is written over."""
    if len(scores) and max(scores.max(), -scores.min()) > PLAIN_EXP:
        scores -= scores.max(axis=1, keepdims=True)
    own = scores[row, which]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], scores.dtype))[row]


def _less_likely(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e**x). ``x`` is written over."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def drawn(parts: Iterator[tuple[np.ndarray, ...]], rng: np.random.Generator) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches (two, one, number) of each part, DRAWS a token; STEPS at least, the rest of them from the last part."""
    taken, part = 0, None
    for part in parts:
        for _ in range(-(-int(len(part[0]) * DRAWS) // BATCH)):
            some = rng.integers(0, len(part[0]), BATCH)
            yield tuple(x[some] for x in part)
            taken += 1
    for _ in range(STEPS - taken if part else 0):
        some = rng.integers(0, len(part[0]), BATCH)
        yield tuple(x[some] for x in part)


def visited(parts: Iterator[tuple[np.ndarray, ...]], rng: np.random.Generator) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches (two, one, number) that together have every token of each part once, in random order; if they are fewer than STEPS, the rest is drawn from the last part."""
    taken, part = 0, None
    for part in parts:
        order = rng.permutation(len(part[0]))
        for some in np.array_split(order, -(-len(order) // BATCH)):
            yield tuple(x[some] for x in part)
            taken += 1
    if part and taken < STEPS:
        yield from islice(drawn(iter([part]), rng), STEPS - taken)


def _sorted(at: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers up to ``most``, in the smallest type that holds them, which numpy sorts by digits."""
    return np.argsort(at.astype(np.min_scalar_type(most)), kind="stable")


def totals(at: np.ndarray, vectors: np.ndarray, of: np.ndarray, by: np.ndarray | None, most: int, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers among ``at``, up to ``most``, from ``base`` on; how often each stands; its sum of vectors[of] * by)."""
    order = _sorted(at, most)
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))
    each = np.take(vectors, of[order], axis=0)
    by = np.ones(len(at), np.float32) if by is None else by[order]
    out = each[first] * by[first, None]
    often = np.flatnonzero(n > FEW)
    for i, low, high in zip(often.tolist(), first[often].tolist(), (first[often] + n[often]).tolist(), strict=True):
        np.dot(by[low:high], each[low:high], out=out[i])
    more = np.flatnonzero((n > 1) & (n <= FEW))
    for j in range(1, FEW):
        more = more[n[more] > j]
        also = first[more] + j
        out[more] += each[also] * by[also, None]
    return base + at[first], n, out


def train(p: np.ndarray, shape: Shape, batches: Iterator[tuple[np.ndarray, ...]], rng: np.random.Generator, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(model, how often each row was trained) after a noise-contrastive step (Adagrad) on each batch of tokens with their contexts."""
    p, times = p.copy(), np.zeros(len(p))
    targets, classes, maps, rows = shape.rows
    squares = np.full(p.shape, 1e-3, np.float32)
    k = len(shape.bounds) - 1
    share = np.exp(shape.share)
    upto = np.cumsum(share)
    begin = np.searchsorted(upto, np.arange(int(upto[-1] * CELLS) + 2) / CELLS, "right").astype(np.int32)
    lowest, highest = upto[shape.bounds[:-1]] - share[shape.bounds[:-1]], upto[shape.bounds[1:] - 1]
    class_p = np.exp(shape.class_share)
    class_p /= class_p.sum()
    class_level = (np.log(NOISE) + shape.class_share).astype(np.float32)
    level = (np.log(NOISE_WITHIN) + shape.share).astype(np.float32)
    several = np.diff(shape.bounds) > 1

    def move(u: np.ndarray, n: np.ndarray, g: np.ndarray) -> None:
        g /= np.sqrt(n)[:, None].astype(np.float32)
        upon = np.take(squares, u, axis=0)
        upon += g * g
        squares[u] = upon
        g *= rate
        g /= np.sqrt(upon, out=upon)
        p[u] += g
        times[u] += n

    for a, b, w in batches:
        # Sorted, so that tokens of a class, and their noise, lie together.
        order = _sorted(w, shape.tokens)
        a, b, w = a[order], b[order], w[order]
        size, kind = len(w), shape.kind[w]
        contexts, mapped = embedded(p, a, b), both_maps(p, shape)
        r = near(contexts, mapped)
        # Classes: one set of noise for the batch. The last number of a row is its bias, for which r has a one.
        noise_classes = rng.choice(k, NOISE, p=class_p)
        own = np.take(p, classes + kind, axis=0)
        up = _less_likely(np.einsum("bd,bd->b", r, own) - class_level[kind])
        noisy = p[classes + noise_classes]
        against = -noisy
        against[:, WIDTH] += class_level[noise_classes]
        down = _less_likely(r @ against.T)
        own *= up[:, None]
        back = own[:, :WIDTH] - down @ noisy[:, :WIDTH]
        there = np.flatnonzero(np.diff(kind, prepend=-1))
        of_class = np.zeros((k, WIDTH + 1), np.float32)
        for c, low, high in zip(kind[there].tolist(), there.tolist(), [*there[1:].tolist(), size], strict=True):
            np.dot(up[low:high], r[low:high], out=of_class[c])
        np.subtract.at(of_class, noise_classes, down.T @ r)
        seen = np.bincount(np.concatenate([kind, noise_classes]), minlength=k)
        # Tokens within the class, where it has several: noise of its own for each.
        chance = rng.random((size, NOISE_WITHIN))
        inside = np.flatnonzero(several[kind])
        trained = None
        if len(inside):
            w, kind, own_r = w[inside], kind[inside], np.take(r, inside, axis=0)
            low, high = lowest[kind], highest[kind]
            noise = found(upto, begin, low[:, None] + chance[inside] * (high - low)[:, None])
            noise = np.clip(noise, shape.bounds[kind][:, None], shape.bounds[kind + 1][:, None] - 1)
            own = np.take(p, targets + w, axis=0)
            far = np.take(p, targets + noise, axis=0)
            up = _less_likely(np.einsum("bd,bd->b", own_r, own) - level[w])
            down = -_less_likely(level[noise] - np.einsum("bd,bnd->bn", own_r, far))
            own *= up[:, None]
            own += np.einsum("bn,bnd->bd", down, far)
            back[inside] += own[:, :WIDTH]
            each = np.arange(len(w))
            trained = totals(np.concatenate([w, noise.ravel()]), own_r, np.concatenate([each, np.repeat(each, NOISE_WITHIN)]), np.concatenate([up, down.ravel()]), shape.tokens, targets)
        here = np.flatnonzero(seen)
        move(classes + here, seen[here], of_class[here])
        if trained:
            move(*trained)
        move(*totals(np.stack([a, b], axis=1).ravel(), (back @ mapped.T).reshape(-1, WIDTH + 1), np.arange(2 * size), None, shape.tokens))
        turns = np.zeros((2, WIDTH, WIDTH + 1), np.float32)
        turns[..., :WIDTH] = (contexts.T @ back).reshape(2, WIDTH + 1, WIDTH)[:, :WIDTH] / np.float32(np.sqrt(size))
        move(np.arange(maps, rows), np.ones(rows - maps, np.int64), turns.reshape(-1, WIDTH + 1))
    return p, times


def found(upto: np.ndarray, begin: np.ndarray, x: np.ndarray) -> np.ndarray:
    """np.searchsorted(upto, x, "right"), which ``begin`` has for each CELLS-th of one; only what lies past a number of its cell is searched."""
    out = begin[(x * CELLS).astype(np.int64)]
    past = np.take(upto, out, mode="clip") <= x
    out[past] = np.searchsorted(upto, x[past], "right")
    return out


def _held(batches, head: Head) -> Iterator[tuple[np.ndarray, ...]]:
    """(two, one, number) of some HELD tokens at a time."""
    held, n = [], 0
    for batch in batches:
        for c in chunks(batch.column(1)):
            number, one, two = numbered(c, head)[4:]
            held.append([x.astype(np.int32) for x in (two, one, number)])
            n += len(number)
            if n >= HELD:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _round(shared, nth: int):
    """A round in one task: its model's rows times how often they were trained, and how often."""

    def run(batches):
        hash_, count, kind, p, shape = shared.value
        head, shape = Head(hash_, count, kind), Shape(*shape)
        # The seed is the part's first tokens: a task that is run again draws the same.
        parts = _held(batches, head)
        first = next(parts, None)
        if first is None:
            return
        rng = np.random.default_rng([nth, int(first[2].sum(dtype=np.int64)), len(first[2])])
        made, times = train(p, shape, visited(chain([first], parts), rng), rng, 0.1 / (1 + nth))
        seen = np.flatnonzero(times)
        for at in range(0, len(seen), 1 << 13):
            rows = seen[at : at + (1 << 13)]
            sums = made[rows].astype(np.float64) * times[rows, None]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(times[rows]), *[pa.array(np.ascontiguousarray(x)) for x in sums.T]], ["row", "times", *COLUMNS])

    return run


COLUMNS = [f"v{i}" for i in range(WIDTH + 1)]


def fitted(training: DataFrame, head: Head, shape: Shape) -> np.ndarray:
    """The model after ROUNDS rounds that share ``training`` (doc_id, text). Its rows, of a fixed number, are all that reaches the driver."""
    p = start(shape)
    sc = training.sparkSession.sparkContext
    for nth in range(ROUNDS):
        shared = sc.broadcast((head.hash, head.count, head.kind, p, (shape.tokens, shape.bounds, shape.kind, shape.class_share, shape.share)))
        rows = training.where(in_round(nth)).mapInArrow(_round(shared, nth), "row long, times double, " + ", ".join(f"{c} double" for c in COLUMNS))
        got = rows.groupBy("row").agg(F.sum("times").alias("times"), *[F.sum(c).alias(c) for c in COLUMNS]).toArrow()
        at, times = got["row"].to_numpy(), got["times"].to_numpy()
        p = p.copy()
        if len(at):
            p[at] = np.stack([got[c].to_numpy() for c in COLUMNS], axis=1) / times[:, None]
    return p


SCORED = "doc_id long, n_tokens long, n_head long, head_sum double, n_other long, other_sum double, classes double, rare array<long>, times array<int>"


def _score(shared):
    def run(batches):
        hash_, count, kind, p, shape = shared.value
        head, shape = Head(hash_, count, kind), Shape(*shape)
        logs = np.log10(head.count + 1.0)
        for batch in batches:
            parts = []
            for c in chunks(batch.column(1), SCORED_BYTES):
                h, begin, known, k, number, one, two = numbered(c, head)
                q = log_probabilities(p, shape, two, one, number) / np.log(10)
                own = np.where(known, logs[k], 0.0) if len(logs) else np.zeros(len(h))
                other = number == shape.tokens - 1
                row = np.repeat(np.arange(c.rows), np.diff(begin))
                add = lambda x: np.bincount(row, x, c.rows)  # noqa: B023, E731
                rare = np.flatnonzero(~known)
                order = rare[np.lexsort((h[rare], row[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                first = np.flatnonzero(new)
                parts.append((np.diff(begin), add(known), add(own), add(other), add(own * other), add(q), h[order[first]].view(np.int64), np.diff(np.append(first, len(order))), np.bincount(row[order[first]], minlength=c.rows)))
            if not parts:
                continue
            n, known, own, other, both, q, rare, times, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x.astype(np.int64)) for x in (n, known)], pa.array(own), pa.array(other.astype(np.int64)), pa.array(both), pa.array(q), lists(rare, lengths, pa.int64()), lists(times.astype(np.int32), lengths, pa.int32())],
                ["doc_id", "n_tokens", "n_head", "head_sum", "n_other", "other_sum", "classes", "rare", "times"],
            )

    return run


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(~held_out())
    counts = keep(training.mapInArrow(_count_tokens, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "tokens")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, "c", HEAD)[0].toArrow()
    head = make_head(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy())
    named = head.kind < VOCABULARY
    by_number = np.zeros(min(len(head.hash), VOCABULARY) + 1)
    by_number[head.kind[named]] = head.count[named]
    by_number[-1] = total.n - by_number[:-1].sum()
    shape = shape_of(by_number)
    model = fitted(training, head, shape)
    n_other = int(by_number[-1]) + int(total.v - (len(by_number) - 1)) + 1
    made = docs.mapInArrow(_score(spark.sparkContext.broadcast((head.hash, head.count, head.kind, model, (shape.tokens, shape.bounds, shape.kind, shape.class_share, shape.share)))), SCORED)
    made = keep(made.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = made.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = rare.join(counts, "h").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_sum"), F.sum("times").alias("rare_known"))
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return made.join(found, "uid", "left").select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + rare_sum - F.col("n_tokens") * float(np.log10(total.n + total.v + 1))).alias("base_score"),
        (F.col("classes") + F.col("other_sum") + rare_sum - F.col("n_other") * float(np.log10(n_other))).alias("score"),
    )
