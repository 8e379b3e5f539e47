"""Exact nearest neighbours of query vectors among all vectors, by tiles of matrix products."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as X

LISTS = "q long, part int, q_ids binary, ids binary, sims binary, width int"


def vectors_of(ids: pa.Array, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and rows of a matrix for each dimension; what is null, empty or not finite is left out."""
    first, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    width = np.diff(first)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    ok = (width > 0) & (bad[first[1:]] == bad[first[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(width[ok]):
        rows = np.flatnonzero(ok & (width == dim))
        yield ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype("<i8"), values[first[rows][:, None] + np.arange(dim)]


def _tiles(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = itertools.count(TaskContext.get().partitionId() << 32)

        def tile(ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).astype("<f8")
            return pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([next(number)]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["dim", "tile", "n", "ids", "m"])

        for b in batches:
            for ids, m in vectors_of(b.column(0), b.column(1)):
                held = waiting.setdefault(m.shape[1], [])
                held.append((ids, m))
                if sum(len(i) for i, _ in held) < rows:
                    continue
                ids, m = (np.concatenate(x) for x in zip(*held))
                whole = len(ids) - len(ids) % rows
                for lo in range(0, whole, rows):
                    yield tile(ids[lo : lo + rows], m[lo : lo + rows])
                held[:] = [(ids[whole:], m[whole:])]
        for held in waiting.values():
            ids, m = (np.concatenate(x) for x in zip(*held))
            if len(ids):
                yield tile(ids, m)

    return run


def best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first columns of each row by similarity (down), then id (up)."""
    if ids.shape[1] > 4 * k:
        # everything at or above each row's k-th similarity stays, so that ties are decided by id
        kth = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        keep = sims >= kth
        width = int(keep.sum(axis=1).max())
        if width < ids.shape[1]:
            at = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            kept = np.take_along_axis(keep, at, 1)
            ids, sims = np.take_along_axis(ids, at, 1), np.where(kept, np.take_along_axis(sims, at, 1), -np.inf)
    order = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _tile_best(k: int, digits: int, q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one tile for each query, in strips of rows."""
    out_i, out_s = [], []
    for lo in range(0, len(q), 512):
        sims = np.round(q[lo : lo + 512] @ s.T, digits) + 0.0
        sims[q_ids[lo : lo + 512, None] == s_ids[None, :]] = -np.inf
        i, x = best(np.broadcast_to(s_ids, sims.shape), sims, k)
        out_i.append(i), out_s.append(x)
    return np.concatenate(out_i), np.concatenate(out_s)


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q_ids = pdf.q_ids.iloc[0]
        n = len(q_ids) // 8
        ids = np.concatenate([np.frombuffer(i, "<i8").reshape(n, w) for i, w in zip(pdf.ids, pdf.width)], axis=1)
        sims = np.concatenate([np.frombuffer(x, "<f8").reshape(n, w) for x, w in zip(pdf.sims, pdf.width)], axis=1)
        ids, sims = best(ids, sims, k)
        return pd.DataFrame({"q": [pdf.q.iloc[0]], "part": [pdf.part.iloc[0]], "q_ids": [q_ids], "ids": [ids.astype("<i8").tobytes()], "sims": [sims.astype("<f8").tobytes()], "width": [ids.shape[1]]})

    return run


def _lists():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_ids, ids, sims, w in zip(*(b.column(i).to_pylist() for i in range(4))):
                q = np.frombuffer(q_ids, "<i8")
                ids, sims = np.frombuffer(ids, "<i8"), np.frombuffer(sims, "<f8")
                ok = np.isfinite(sims)
                rank = np.tile(np.arange(1, w + 1), len(q))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, w)[ok]), pa.array(rank[ok].astype(np.int32)), pa.array(ids[ok]), pa.array(sims[ok])], ["vec_id", "rank", "neighbor_id", "similarity"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, tile_rows: int = 2048, side_tiles: int = 8, fan_in: int = 16, digits: int = 6) -> DataFrame:
    """(vec_id, rank, neighbor_id, similarity): the k most similar vectors for each query, by cosine, exactly.

    Both tables need vec_id (numbers) and embedding (array of numbers).  Tiles are dealt to sides of about
    ``side_tiles``; every pair of a side of queries and one of vectors is one task's work, in which each tile of queries meets
    each tile of vectors in one matrix product.  The k best of each query are merged
    within the pair of sides, then ``fan_in`` sides at a time until one list is left.  Similarities are
    rounded to ``digits``; ties go to the smaller id.  A row with the query's vec_id is no
    neighbour of it; queries that repeat get a list each, and vectors that repeat are neighbours each by itself.
    Vectors are compared with those of the same dimension only, of whatever length; a zero vector has
    similarity 0 to all.  Null ids, null or empty vectors and those that hold null, NaN
    or infinity are left out; an id that is no number is an error.  Other columns are ignored, an empty table on either side gives an empty
    result.
    """

    def tiles(df: DataFrame, what: str) -> tuple[DataFrame, int]:
        slim = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        t = X.written(slim.mapInArrow(_tiles(tile_rows), "dim int, tile long, n int, ids binary, m binary"), what)
        return t, max(1, -(-t.count() // side_tiles))

    def dealt(sides: int) -> Column:
        return F.pmod(F.xxhash64("tile"), F.lit(sides)).cast("int")

    def every(sides: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))

    (a, q_sides), (b, s_sides) = tiles(queries, "query-tiles"), tiles(vectors, "tiles")
    q = a.select("dim", dealt(q_sides).alias("q_side"), every(s_sides).alias("part"), "tile", "n", "ids", "m").groupBy("dim", "q_side", "part")
    s = b.select(F.col("dim").alias("s_dim"), every(q_sides).alias("to_side"), dealt(s_sides).alias("s_side"), F.col("n").alias("s_n"), F.col("ids").alias("s_ids"), F.col("m").alias("s_m")).groupBy("s_dim", "to_side", "s_side")
    lists = q.cogroup(s).applyInPandas(_cell(k, digits), LISTS)
    count = s_sides
    while count > 1:
        count = -(-count // fan_in)
        lists = lists.withColumn("part", F.pmod("part", F.lit(count))).groupBy("q", "part").applyInPandas(_merge(k), LISTS)
    return lists.select("q_ids", "ids", "sims", "width").mapInArrow(_lists(), "vec_id long, rank int, neighbor_id long, similarity double")


def _cell(k: int, digits: int):
    """Products of all tiles of two sides: one list for each tile of queries."""

    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        dim, _, part = key
        others = [(np.frombuffer(r.s_ids, "<i8"), np.frombuffer(r.s_m, "<f8").reshape(r.s_n, dim)) for r in vectors.itertuples(index=False)]
        rows = []
        for r in queries.itertuples(index=False) if others else ():
            q_ids, q = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.m, "<f8").reshape(r.n, dim)
            found = [_tile_best(k, digits, q_ids, q, ids, m) for ids, m in others]
            ids, sims = best(np.concatenate([i for i, _ in found], axis=1), np.concatenate([x for _, x in found], axis=1), k)
            rows.append((r.tile, part, r.ids, ids.astype("<i8").tobytes(), sims.astype("<f8").tobytes(), ids.shape[1]))
        return pd.DataFrame(rows, columns=["q", "part", "q_ids", "ids", "sims", "width"])

    return run
