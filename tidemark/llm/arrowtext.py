"""Words of whole texts as numpy arrays, straight from Arrow buffers.

No Python object is made for a word. A word is known by a 64-bit polynomial
hash of its bytes. Modulo 2**64 such a hash tells short words apart as well as
a random one does, but not all words of a thousand bytes; words of more than
LONG bytes therefore get XXH64 of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MULTIPLIER = 0xD1342543DE82EF95
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
CHUNK = 1 << 19
LONG = 128

_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(CHUNK + 1, n)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words, and the value each has in the hash (0: none)."""

    values: np.ndarray
    word: np.ndarray
    lower: bool


def alphabet(separators: bytes, lower: bool) -> Alphabet:
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    if lower:
        values[65:91] = values[97:123]
    word = np.ones(256, bool)
    word[list(separators)] = False
    values = np.where(word, values, np.uint64(0))
    return Alphabet(values, word, lower)


#: ``[^\x20\x09-\x0D]+``
SPACED = b" \t\n\x0b\x0c\r"
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

PLAIN = alphabet(SPACED, lower=False)
PLAIN_LOWER = alphabet(SPACED, lower=True)
ALNUM = alphabet(NOT_ALNUM, lower=True)


@dataclass
class Chunk:
    """Some consecutive rows: ``data`` holds their bytes, row i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(text: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Whole texts in pieces of about ``limit`` bytes; a null text has no bytes."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    if not len(text):
        return
    wide = pa.types.is_large_string(text.type)
    raw = text.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(text))
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """Words of a chunk, in order: hash, first byte, byte after the last, and where each row's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: Alphabet) -> np.ndarray:
    """Hash of each stretch data[start:end]."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters.values[data] * powers(MULTIPLIER, n), out=sums[1:])
    h = mixed((sums[end] - sums[start]) * powers(INVERSE, n + 1)[start])
    for i in np.flatnonzero(end - start > LONG).tolist():
        raw = data[start[i] : end[i]].tobytes()
        h[i] = xxhash.xxh64_intdigest(raw.lower() if letters.lower else raw)
    return h


def words(chunk: Chunk, letters: Alphabet) -> Words:
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = letters.word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    stops[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    h = hashes(data, start, end, letters)
    return Words(h, start, end, np.searchsorted(start, offsets))


def hash_of(word: str | bytes, letters: Alphabet) -> int:
    """The hash that :func:`words` gives to one word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(words(Chunk(0, raw, np.array([0, len(raw)])), letters).hash[0])


def words_of(text: str, letters: Alphabet) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(Chunk(0, raw, np.array([0, len(raw)])), letters).hash


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from all values in a row and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
