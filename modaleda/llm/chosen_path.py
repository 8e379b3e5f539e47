"""Jaccard self-join of documents' word n-gram sets by chosen paths.

Documents with equal sets are one class, which stands for them in the search.  Each run walks a
random tree.  A node is a bucket of classes; it picks ``degree`` of the ``SKETCH`` sampling positions that
its ancestors have not used, and a class goes on to the child named by the token that is its own sample (least
hash, so far as one token stands for its position) there.  Two sets of Jaccard similarity s share a
sample with probability s, so similar sets meet again and again while others part.  Buckets above ``bucket``
classes are split again, until they are small or a child holds more than half of its parent (sets so
alike that no token parts them).  As degree x threshold is above 1, a pair at the threshold meets with a
probability that no depth brings down, from which the number of ``runs`` follows for the target recall.

What is left is compared, all with all, in units of two blocks of a bucket at most, so a large bucket is the work of
many tasks.  Comparison is in two steps: byte sketches first (with a margin below the threshold), then
the whole sets, exactly.  Pairs are never put out.  A pair that meets in several buckets belongs to the least of
these, where its link is counted for both sides; a unit gives each class its number of links and
the least class that it is linked to there, and connected components follow from the latter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as X
from . import words as W

SKETCH = 64
_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)


def shingles(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row, and where each row's begin; a text of fewer than n words has one gram, all of it."""
    w = W.words(text)
    at, h = W.grams(w, n)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([np.uint64(W.mix(np.array([sum(int(x) * pow(31, j, 1 << 64) for j, x in enumerate(w.hash[w.first[r] : w.first[r + 1]])) % (1 << 64)], dtype=np.uint64))[0]) for r in short], dtype=np.uint64)
        row = np.concatenate([w.row[at], short])
        order = np.argsort(row, kind="stable")
        return np.concatenate([h, whole])[order], np.searchsorted(row[order], np.arange(len(text) + 1))
    return h, np.searchsorted(w.row[at], np.arange(len(text) + 1))


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with each row's hashes sorted, and once each."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(first)))


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least of each of SKETCH hash functions over each row (rows without n-grams must be left out first)."""
    h32 = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SKETCH, len(first) - 1), dtype=np.uint32)
    for i in range(SKETCH):
        x = h32 * _MUL[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x += _ADD[i]
        out[i] = np.minimum.reduceat(x, first[:-1])
    return out.T


def _digests(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set (none of them empty)."""
    first = W.mix(np.add.reduceat(W.mix(u), at[:-1]) + np.diff(at).astype(np.uint64))
    return first.view(np.int64), np.bitwise_xor.reduceat(u, at[:-1]).view(np.int64)


def _emit(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, th = batch.columns
            for lo, hi in W.chunks(text):
                h, first = shingles(text.slice(lo, hi - lo), n)
                keep = np.flatnonzero(np.diff(first) > 0)
                if not len(keep):
                    continue
                starts = np.append(first[:-1][keep], first[-1])
                sk = sketches(h, starts)
                u, at = distinct(h, starts)
                digest, digest2 = _digests(u, at)
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).take(rows), th.slice(lo, hi - lo).take(rows), pa.array(digest), pa.array(digest2), pa.array([r.tobytes() for r in sk.astype("<u4")], type=pa.binary())],
                    ["doc", "th", "digest", "digest2", "sketch"],
                )

    return run


# the tree


def _children(path: np.ndarray, used: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the children of each row's node (-1: none is left), and seeds of their keys: rows x degree.  They depend on the node alone."""
    seed = W.mix(path)
    step = (W.mix(seed) >> np.uint64(32)) | np.uint64(1)  # odd: all positions come up
    order = ((seed[:, None] + np.arange(SKETCH, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(SKETCH)).astype(np.int64)
    free = (used[:, None] >> order.astype(np.uint64)) & np.uint64(1) == 0
    rank = np.cumsum(free, axis=1)
    at = np.full((len(path), degree), -1)
    for d in range(degree):
        hit = free & (rank == d + 1)
        some = hit.any(axis=1)
        at[some, d] = order[some, hit[some].argmax(axis=1)]
    return at, W.mix(seed[:, None] ^ np.arange(1, degree + 1, dtype=np.uint64)[None, :])


def _keys(seeds: np.ndarray, sketch: np.ndarray, at: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of child d and the rows that have one."""
    rows = np.flatnonzero(at[:, d] >= 0)
    return W.mix(seeds[rows, d] + sketch[rows, at[rows, d]].astype(np.uint64)), rows


NODE = "path long, used long, cls long, sketch binary, above long"


def _node(keys: np.ndarray, rows: np.ndarray, used: np.ndarray, at: np.ndarray, cls: pa.Array, small: pa.Array, above: pa.Array) -> pa.RecordBatch:
    mask = used[rows] | np.left_shift(np.uint64(1), at[rows].astype(np.uint64))
    index = pa.array(rows)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(mask.view(np.int64)), cls.take(index), small.take(index), above.take(index)], ["path", "used", "cls", "sketch", "above"])


def _roots(runs: int, degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            full = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u4").reshape(-1, SKETCH)
            small = pa.array([r.tobytes() for r in (full & 0xFF).astype(np.uint8)], type=pa.binary())
            none = pa.nulls(len(full), pa.int64())
            for r in range(runs):
                used = np.zeros(len(full), dtype=np.uint64)
                at, seeds = (np.repeat(x, len(full), axis=0) for x in _children(np.array([(r + 1) * 0x9E3779B97F4A7C15 % (1 << 64)], dtype=np.uint64), used[:1], degree))
                for d in range(degree):
                    keys, rows = _keys(seeds, full, at, d)
                    yield _node(keys, rows, used, at[:, d], b.column(0), small, none)

    return run


def _deeper(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            path, used = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            at, seeds = _children(path, used, degree)
            for d in range(degree):
                keys, rows = _keys(seeds, sketch, at, d)
                if len(rows):
                    yield _node(keys, rows, used, at[:, d], b.column(2), b.column(3), b.column(4))

    return run


# units of comparison


def _units(batches: Iterator[pa.RecordBatch], least: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole units, and where each begins (with an end); rows come sorted by their first three columns (path, lo, hi)."""

    def cuts(b: pa.RecordBatch) -> np.ndarray:
        new = np.ones(b.num_rows + 1, dtype=bool)
        new[1:-1] = np.any([np.diff(b.column(i).to_numpy()) != 0 for i in range(3)], axis=0)
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    waiting = 0

    def wide(b: pa.RecordBatch) -> pa.RecordBatch:
        """b with room beyond 2 GB; each batch gets it, as what is held over must have the types of what comes next."""
        return b.cast(pa.schema([f.with_type(pa.large_binary()) if pa.types.is_binary(f.type) else f for f in b.schema]))

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(wide(batch))
        waiting += batch.num_rows
        if waiting >= least:
            b = joined()
            at = cuts(b)
            if len(at) > 2:
                yield b.slice(0, at[-2]), at[:-1]
                held = [b.slice(at[-2])]
                waiting = held[0].num_rows
                continue
            else:
                held = [b]
            waiting = 0
    if held:
        b = joined()
        yield b, cuts(b)


SMALL = 64  # units of up to so many rows are compared together


def _small_pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each of the units of up to SMALL rows."""
    size = np.diff(at)
    left = np.repeat(np.where(size <= SMALL, size, 0), size) - (np.arange(at[-1]) - np.repeat(at[:-1], size))  # rows from here to the unit's end
    out = [np.flatnonzero(left > d) for d in range(1, min(SMALL, int(size.max())))]
    return np.concatenate([np.zeros(0, np.int64), *out]), np.concatenate([np.zeros(0, np.int64), *(x + d for d, x in enumerate(out, 1))])


class _Paths:
    """The buckets in which the class of each row is."""

    def __init__(self, lists: pa.ListArray, own: np.ndarray):
        first, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        n = np.diff(first)
        self.of = np.full((len(own), max(1, int(n.max(initial=0)))), np.iinfo(np.int64).min)
        row = np.repeat(np.arange(len(own)), n)
        self.of[row, np.arange(first[0], first[-1]) - np.repeat(first[:-1], n)] = values[first[0] : first[-1]]
        none = np.iinfo(np.int64).min
        self.below = np.where((self.of < own[:, None]) & (self.of != none), self.of, none + 1)
        self.bits: np.ndarray | None = None

    def _often(self, most: int = 64) -> np.ndarray:
        """A bit for each of the buckets that most rows have below their own, so that rows of large buckets need not compare their lists."""
        if self.bits is None:
            paths, at, n = np.unique(self.below, return_inverse=True, return_counts=True)
            n[paths == np.iinfo(np.int64).min + 1] = 0
            top = np.argsort(-n, kind="stable")[:most]
            bit = np.zeros(len(paths), dtype=np.uint64)
            bit[top] = np.where(n[top] > 0, np.left_shift(np.uint64(1), np.arange(len(top), dtype=np.uint64)), np.uint64(0))
            self.bits = np.bitwise_or.reduce(bit[at.reshape(self.below.shape)], axis=1)
        return self.bits

    def owned(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a pair of rows of one bucket is in no smaller bucket together."""
        out = np.ones(len(a), dtype=bool)
        if len(a) > len(self.of):
            bits = self._often()
            out = bits[a] & bits[b] == 0
        left = np.flatnonzero(out)
        for lo in range(0, len(left), 20_000):
            some = left[lo : lo + 20_000]
            x, y = self.below[a[some]], self.of[b[some]]
            out[some] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
        return out


def _agree(sk: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many positions the byte sketches of pairs of rows agree."""
    out = np.empty(len(a), dtype=np.uint8)
    for lo in range(0, len(a), 1 << 15):
        out[lo : lo + (1 << 15)] = (sk[a[lo : lo + (1 << 15)]] == sk[b[lo : lo + (1 << 15)]]).sum(axis=1)
    return out


def _sides(block: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    return [np.flatnonzero(block == lo), np.flatnonzero(block == hi)] if lo != hi else [np.arange(len(block))]


def _strips(a: np.ndarray, b: np.ndarray, same: bool, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strips of rows of a, each with all of b (from the strip on, if both are the same side)."""
    for lo in range(0, len(a), rows):
        yield a[lo : lo + rows], b[lo:] if same else b


def _rest(sides: list[np.ndarray], near: list[np.ndarray], joined: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """What remains to be compared (side, side, whether they are the same rows), once the rows near[i] of each side hang on that side's first row.

    A pair of two rows that hang together needs no link of its own.
    """
    if len(sides) == 1:
        far = np.setdiff1d(sides[0], near[0])
        yield far, near[0], False
        yield far, far, True
        return
    (a, b), (na, nb) = sides, near
    fa, fb = np.setdiff1d(a, na), np.setdiff1d(b, nb)
    yield fa, b, False
    yield na, fb, False
    if not joined:
        yield na, nb, False


def _alike(at_least: int, sure: int, count: bool):
    """(cls, path, lo, hi, block, paths) of the rows of a unit that have a pair of their own there whose byte sketches agree in at_least positions.

    Unless links are to be counted, rows that agree in ``sure`` positions with the first of their side are paired with that one alone.
    """

    def block_pairs(sk: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in _strips(a, b, same):
            n = np.zeros((len(x), len(y)), dtype=np.uint8)
            for i in range(SKETCH):
                n += sk[x, i, None] == sk[None, y, i]
            i, j = np.nonzero(n >= at_least)
            i, j = x[i], y[j]
            yield (i[i < j], j[i < j]) if same else (i, j)

    def large(sk: np.ndarray, block: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sides = _sides(block, lo, hi)
        if count or min(map(len, sides)) == 0:
            yield from block_pairs(sk, sides[0], sides[-1], len(sides) == 1)
            return
        agree = [_agree(sk, np.full(len(s), s[0]), s) for s in sides]
        if len(sides) == 1:
            alike = sides[0][(agree[0] >= at_least) & (sides[0] != sides[0][0])]
            yield np.full(len(alike), sides[0][0]), alike
        joined = len(sides) == 2 and _agree(sk, sides[0][:1], sides[1][:1])[0] >= sure
        if joined:
            yield sides[0][:1], sides[1][:1]
        for a, b, same in _rest(sides, [s[n >= sure] for s, n in zip(sides, agree)], joined):
            yield from block_pairs(sk, a, b, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in _units(batches):
            path, lo, hi, block = (b.column(i).to_numpy() for i in range(4))
            sk = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            paths = _Paths(b.column(6), path)
            marked = np.zeros(b.num_rows, dtype=bool)

            def mark(i: np.ndarray, j: np.ndarray, paths: _Paths = paths, marked: np.ndarray = marked) -> None:
                mine = paths.owned(i, j)
                marked[i[mine]] = marked[j[mine]] = True

            i, j = _small_pairs(at)
            ok = (lo[i] == hi[i]) | (block[i] != block[j])
            i, j = i[ok], j[ok]
            ok = _agree(sk, i, j) >= at_least
            mark(i[ok], j[ok])
            for u in np.flatnonzero(np.diff(at) > SMALL):
                s, e = at[u], at[u + 1]
                for i, j in large(sk[s:e], block[s:e], lo[s], hi[s]):
                    mark(s + i, s + j)
            index = pa.array(np.flatnonzero(marked))
            yield pa.RecordBatch.from_arrays([b.column(k).take(index) for k in (4, 0, 1, 2, 3, 6)], ["cls", "path", "lo", "hi", "block", "paths"])

    return run


class Sets:
    """Sets of hashes as rows of a matrix of 0 and 1, of whose columns those that two rows hold or more are kept."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], dtype=np.float64)
        grams, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), self.size.astype(np.int64))
        often = np.flatnonzero(np.bincount(column, minlength=len(grams)) > 1)
        new = np.full(len(grams), -1)
        new[often] = np.arange(len(often))
        column = new[column]
        keep = column >= 0
        order = np.argsort(column[keep], kind="stable")
        self.row, self.column, self.width = row[keep][order], column[keep][order], len(often)

    def _tile(self, rows: np.ndarray, i: int, j: int, c: int, width: int) -> np.ndarray:
        at = np.full(len(self.size), -1)
        at[rows] = np.arange(len(rows))
        m = np.zeros((len(rows), width), dtype=np.float32)
        r = at[self.row[i:j]]
        m[r[r >= 0], self.column[i:j][r >= 0] - c] = 1
        return m

    def pairs(self, a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tile: int = 1024, width: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of a, row of b, similarity) of at least the threshold, once for each pair if both sides are the same."""
        for x, rest in _strips(a, b, same, tile):
            for lo in range(0, len(rest), tile):
                y = rest[lo : lo + tile]
                both = np.zeros((len(x), len(y)), dtype=np.float32)
                for c in range(0, self.width, width):
                    i, j = np.searchsorted(self.column, [c, c + width])
                    w = min(width, self.width - c)
                    m = self._tile(x, i, j, c, w)
                    both += m @ (m if len(x) == len(y) and x is y else self._tile(y, i, j, c, w)).T
                s = both / (self.size[x][:, None] + self.size[y][None, :] - both)
                i, j = np.nonzero(s >= threshold)
                i, j, s = x[i], y[j], s[i, j]
                yield (i[i < j], j[i < j], s[i < j]) if same else (i, j, s)


def _linked(sets: list[np.ndarray], block: np.ndarray, lo: int, hi: int, threshold: float, count: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a unit at the threshold; unless they are to be counted, so many that the same rows hang together."""
    if len(sets) == 2:
        common = len(sets[0]) + len(sets[1]) - len(np.unique(np.concatenate(sets)))
        if common >= threshold * (len(sets[0]) + len(sets[1]) - common) and (lo == hi or block[0] != block[1]):
            yield np.array([0]), np.array([1])
        return
    sides = _sides(block, lo, hi)
    if min(map(len, sides)) == 0:
        return
    s = Sets(sets)
    if count or len(sets) <= SMALL:
        for i, j, _ in s.pairs(sides[0], sides[-1], len(sides) == 1, threshold):
            yield i, j
        return
    near = []
    for side in sides:
        near.append(side[:1])
        for _, j, _ in s.pairs(side[:1], side[1:], False, threshold):
            yield np.full(len(j), side[0]), j
            near[-1] = np.concatenate([near[-1], j])
    joined = False
    if len(sides) == 2:
        for i, j, _ in s.pairs(sides[0][:1], sides[1][:1], False, threshold):
            joined |= len(i) > 0
            yield i, j
    for a, b, same in _rest(sides, near, joined):
        for i, j, _ in s.pairs(a, b, same, threshold):
            yield i, j


def _roots_of(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each row hangs together with."""
    root = np.arange(n)
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _compare(threshold: float, count: bool):
    """(cls, links, root): exact comparison of the rows of each unit; links are the documents of the classes linked, root is the least class that it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in _units(batches, 1 << 10):
            path, lo, hi, block, cls, docs = (b.column(i).to_numpy() for i in range(6))
            paths = _Paths(b.column(6), path)
            grams = b.column(7)
            out_c, out_n, out_r = [], [], []
            for s, e in zip(at[:-1], at[1:]):
                row = s + np.append(0, np.flatnonzero(np.diff(cls[s:e])) + 1)  # a class whose row is repeated comes more than once
                if len(row) < 2:
                    continue
                sets = [np.frombuffer(grams[int(r)].as_buffer(), dtype=np.uint64) for r in row]
                links, found = np.zeros(len(row), dtype=np.int64), []
                for i, j in _linked(sets, block[row], lo[s], hi[s], threshold, count):
                    if count:  # in one bucket alone
                        mine = paths.owned(row[i], row[j])
                        i, j = i[mine], j[mine]
                    if not len(i):
                        continue
                    found.append((i, j))
                    if count:
                        links += np.bincount(i, docs[row[j]], len(row)).astype(np.int64) + np.bincount(j, docs[row[i]], len(row)).astype(np.int64)
                root = _roots_of(len(row), found)
                some = np.flatnonzero((links > 0) | (root != np.arange(len(row))))
                out_c.append(cls[row[some]]), out_n.append(links[some]), out_r.append(cls[row[root[some]]])
            if out_c:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_c, out_n, out_r)], ["cls", "links", "root"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for lo, hi in W.chunks(text):
                u, at = distinct(*shingles(text.slice(lo, hi - lo), n))
                sets = [u[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(sets, type=pa.binary()), *(c.slice(lo, hi - lo) for c in batch.columns[1:])], ["grams", "cls", "n", "units", "paths"])

    return run


def degree_for(threshold: float) -> int:
    """The least number of children at which a pair at the threshold is not lost at some depth for certain."""
    return math.floor(1 / threshold) + 1


def runs_for(recall: float, threshold: float, degree: int) -> int:
    """Runs after which a pair at the threshold has met with the given probability, however deep the tree."""
    meets = 1.0
    for _ in range(1000):
        meets = 1 - (1 - threshold * meets) ** degree
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets))) if meets < 1 else 1


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text"), F.xxhash64(text).alias("th")).where("doc is not null and text is not null")


def _leaves(classes: DataFrame, runs: int, degree: int, bucket: int) -> tuple[DataFrame, list[DataFrame]]:
    """(path, n, cls, sketch) of the buckets that are to be compared, n classes each, and the tables written for that."""
    nodes = classes.select("cls", "sketch").mapInArrow(_roots(runs, degree), NODE)
    leaves, tables = [], []
    while True:
        count = X.written(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
        there = X.sieve(count.select("path"))
        met = (nodes.where(there(F.col("path"))) if there else nodes).join(count, "path")
        nodes = X.written(met, "buckets")
        tables += [count, nodes]
        small = (F.col("n") <= bucket) | (F.col("n") * 2 > F.col("above")) | (F.bit_count("used") + degree > SKETCH)
        small = F.coalesce(small, F.lit(False))
        leaves.append(nodes.where(small).select("path", "n", "cls", "sketch"))
        large = nodes.where(~small)
        if large.isEmpty():
            break
        nodes = large.select("path", "used", "cls", "sketch", F.col("n").alias("above")).mapInArrow(_deeper(degree), NODE)
    found = leaves[0]
    for x in leaves[1:]:
        found = found.unionByName(x)
    return found, tables


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, bucket: int, block: int, count: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with words (doc, th, digest, digest2), and of the classes of two rows or more, and those linked to others: (digest, digest2, n, links, root, doc, th), the last two the least of those that hang together."""
    degree = degree_for(threshold)
    margin = 2.5 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    at_least, sure = max(1, math.floor(SKETCH * (threshold - margin))), math.ceil(SKETCH * (threshold + margin))
    texts = _texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = X.written(texts.mapInArrow(_emit(n), f"doc {kind}, th long, digest long, digest2 long, sketch binary"), "sketches")
    first = F.min(F.struct("doc", "th")).alias("first")
    classes = rows.groupBy("digest", "digest2").agg(F.count(F.lit(1)).alias("n"), first, F.min("sketch").alias("sketch"))
    classes = X.written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    leaves, tables = _leaves(classes, runs_for(recall, threshold, degree), degree, bucket)
    of = leaves.groupBy("cls").agg(F.min("sketch").alias("sketch"), F.array_sort(F.collect_list(F.struct("path", "n"))).alias("at"))
    of = of.select("cls", "sketch", F.col("at.path").alias("paths"), F.explode("at").alias("at")).select("cls", "sketch", "paths", F.col("at.path").alias("path"), F.ceil(F.col("at.n") / block).cast("int").alias("blocks"))
    of = of.withColumn("block", F.pmod(F.xxhash64("cls", "path"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["path", "lo", "hi"]
    units = of.select("path", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "sketch", "paths")
    marks = X.spread(units, *unit).sortWithinPartitions(*unit, "cls").mapInArrow(_alike(at_least, sure, count), "cls long, path long, lo int, hi int, block int, paths array<long>")
    asked = marks.groupBy("cls").agg(F.collect_list(F.struct(*unit, "block")).alias("units"), F.first("paths").alias("paths"))
    asked = X.written(asked.join(classes.select("cls", "n", "first.doc", "first.th"), "cls"), "asked")
    X.dropped(*tables)
    there = X.sieve(asked.select("doc", "th"))
    slim = (texts.where(there(F.col("doc"), F.col("th"))) if there else texts).join(asked, ["doc", "th"])
    sets = slim.select("text", "cls", "n", "units", "paths").mapInArrow(_sets(n), f"grams binary, cls long, n long, units array<struct<path:long,lo:int,hi:int,block:int>>, paths array<long>")
    sets = sets.select(F.explode("units").alias("u"), "cls", "n", "paths", "grams").select("u.*", "cls", "n", "paths", "grams")
    compared = X.spread(sets, *unit).sortWithinPartitions(*unit, "cls").mapInArrow(_compare(threshold, count), "cls long, links long, root long")
    found = X.written(compared.groupBy("cls", "root").agg(F.sum("links").alias("links")), "links")
    star = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    star = star.unionByName(star.select(F.col("v").alias("u"), "v").distinct())
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(links, "cls", "left").join(star.select(F.col("u").alias("cls"), F.col("v").alias("root")), "cls", "left")
    known = known.where("n > 1 or links is not null or root is not null").select("digest", "digest2", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"), "first")
    known = X.written(known, "known")
    X.dropped(asked, found)
    least = known.groupBy("root").agg(F.min("first").alias("first"))
    return rows.select("doc", "th", "digest", "digest2"), known.drop("first").join(least, "root").select("digest", "digest2", "n", "links", "root", "first.doc", "first.th")


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): for each node but the least of its connected component, that one, by alternating large and small stars until nothing moves."""

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    now = X.written(edges.where("u != v").distinct(), "edges")
    state = _state(now)
    while True:
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        near = both(now)
        large = near.where("v > u").join(near.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        large = X.written(large, "stars")
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.select("u", F.col("m").alias("v")).unionByName(low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = X.written(small, "edges")
        before, state = state, _state(new)
        X.dropped(now, large)
        now = new
        if before == state:
            return now


def similar_classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.95, bucket: int = 1000, block: int = 2048) -> DataFrame:
    """(doc_id, class_id, n_links) of the documents whose set of word n-grams has at least the Jaccard similarity with that of another one.

    docs needs doc_id and text.  n_links is the number of other rows that a row is similar to, copies among
    them; class_id is the smallest doc_id of all that hang together by such links, directly or through others.  A document
    that is similar to none has no row: it is a class of its own.  A text of 1 to n-1 words has one n-gram, all its
    words; rows with a null doc_id, a null text or a text without words take no part.  Rows that repeat, or share
    a doc_id, count each by itself.  Texts of any length are compared whole.  doc_id may be of any type that can be ordered.  Other columns are
    ignored; an empty table gives an empty result.  Links of equal sets are always found.  Whether another pair
    meets at all is a matter of chance, fixed by the code: at the threshold it has the probability ``recall`` at least,
    however large its buckets, and a higher one above.
    """
    rows, known = _classes(docs, threshold, n, recall, bucket, block, True)
    out = rows.join(known.drop("th").withColumnRenamed("doc", "class_id"), ["digest", "digest2"])
    return out.select(F.col("doc").alias("doc_id"), "class_id", (F.col("n") - 1 + F.col("links")).alias("n_links"))


def one_of_each_group(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.95, bucket: int = 1000, block: int = 4096) -> DataFrame:
    """docs without those that are similar, in one step or several, to one of smaller doc_id (of equal ones: of smaller text hash).

    Returns the columns of docs.  Rows that are similar to no other stay, whether or not they share a doc_id, and so do rows without
    doc_id and texts that are null or have no words; of rows that repeat one stays.  An empty table gives an empty one.
    Only the rows that go, and the few that look like them, are shuffled.
    """
    rows, known = _classes(docs, threshold, n, recall, bucket, block, False)
    known = known.withColumnsRenamed({"doc": "least_doc", "th": "least_th"})
    stays = (F.col("doc") == F.col("least_doc")) & (F.col("th") == F.col("least_th"))
    keys = rows.join(known, ["digest", "digest2"]).groupBy("doc", "th").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("copies"))
    keys = X.written(keys.where("not stays or copies > 1").select(F.col("doc").alias("__d__"), F.col("th").alias("__h__"), F.col("stays").alias("__stays__")), "gone")
    text = F.col("text").cast("string")
    p = X.packed(docs, __doc__=F.col("doc_id"), __th__=F.xxhash64(text))
    there = X.sieve(keys.select("__d__", "__h__"))
    asked: Column = F.coalesce(there(F.col("__doc__"), F.col("__th__")), F.lit(False)) if there else F.lit(True)
    p = p.withColumn("__asked__", asked)
    looked = p.where("__asked__").join(keys, (F.col("__doc__") == F.col("__d__")) & (F.col("__th__") == F.col("__h__")), "left").where("__stays__ is null or __stays__")
    once = X.first_of(looked.where("__stays__"), "__doc__", "__th__")
    out = looked.where("__stays__ is null").select(X.ROW).unionByName(once.select(X.ROW))
    return X.unpacked(p.where("not __asked__").select(X.ROW).unionByName(out) if there else out)
