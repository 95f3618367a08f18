"""Words of many texts at once, with numpy on the UTF-8 bytes of an Arrow column.

A text is never turned into Python strings: the bytes of a run of texts are classified by a
256-entry table, and every word gets a 64-bit hash from prefix sums of weighted bytes.
Bytes from 0x80 on (parts of characters outside ASCII) always count as word bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together; a longer text is looked at alone.
CHUNK_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: ``[^\x20\x09-\x0D]``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[32] = NON_SPACE[9:14] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that scatters close ones."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, _INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(CHUNK_BYTES * 2, 1 << (n + 1).bit_length()))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one longer row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


@dataclass
class Words:
    """``hashes[bounds[i]:bounds[i + 1]]`` are those of text i; starts and ends are byte offsets."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, prefixes: tuple[int, ...] = ()) -> Words:
    """Lower-case A-Z and split into maximal runs of bytes of a kind, none across two texts.

    prefixes: lengths in bytes for which to hash the beginnings of words too, 0 for shorter words.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        empty = np.zeros(0, np.uint64)
        return Words(empty, np.zeros(len(offsets), np.int64), none, none, (empty,) * len(prefixes))
    low = LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[low]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge + 1]
    last[edge - 1] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    begun = tuple(
        np.where(ends - starts >= p, mix((total[np.minimum(starts + p, n)] - total[starts]) * down[starts] + np.uint64(p)), np.uint64(0))
        for p in prefixes
    )
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, begun)


def ngrams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words of one text; a shorter non-empty text is one run."""
    h, counts = found.hashes, found.counts
    size = np.maximum(counts - n + 1, (counts > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(counts)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(found.bounds[:-1], size)
    end = np.repeat(found.bounds[1:], size)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        word = padded[at + k]
        word[at + k >= end] = 0
        out = mix(out * _ODD + word + np.uint64(k))
    return out, rows


def as_int64(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))
