"""Vectorised word and n-gram hashing of Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters
of the lower-cased text, i.e. a match of ``[0-9a-z\\x80-\\U0010ffff]+``.  Whole
batches are hashed with prefix sums over the UTF-8 bytes, so no Python object is
made per word.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[0-9a-z\x{80}-\x{10ffff}]+"
CHUNK_BYTES = 1 << 20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IS_WORD[128:] = True
_BASE_BYTE = 0x9E3779B97F4A7C15 | 1
_BASE_WORD = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one per word
    row: np.ndarray  # row of each word
    first: np.ndarray  # index of the first word of each row, one more entry than rows


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield lo, hi
        lo = hi


def words(text: pa.Array) -> Words:
    """Hashes of all words of all rows; a null text has no words."""
    low = pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
    if isinstance(low, pa.ChunkedArray):
        low = low.combine_chunks()
    off = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1]
    if not len(low) or off[-1] == off[0]:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(low) + 1, np.int64))
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:]
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _power(_BASE_BYTE, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data.astype(np.uint64) * power[: len(data)], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s])
    first = np.searchsorted(s, off)
    row = np.repeat(np.arange(len(low)), np.diff(first))
    return Words(h, row, first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all runs of n words within a row."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _power(_BASE_WORD, len(w.hash) + 1)
    total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
    np.cumsum(w.hash * power[: len(w.hash)], out=total[1:])
    at = np.flatnonzero(w.row[:m] == w.row[n - 1 :])
    return at, mix((total[at + n] - total[at]) * inverse[at])
