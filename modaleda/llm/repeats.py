"""Repeated substrings by compacting a de Bruijn graph of the corpus.

The edges of the graph are runs of ``length`` words; two edges follow each other
where they overlap in all but one word.  As in disk-based assemblers, the edges
are partitioned by their minimizer (the least hash among their shorter runs), so
that neighbouring edges travel together: a document ships one row for each
minimizer, with the hashes of the consecutive edges that share it, and a single
shuffle brings equal edges together.  Edges held by one document only go there,
most of them before they are even unpacked.  What is left is compacted:

1. within a minimizer, consecutive edges of a document with the same set of
   occurrences are one piece of a nonbranching path;
2. pieces are joined to their successors on (document, coordinate), and chains
   of pieces with the same set of occurrences become whole nonbranching paths;
3. source coordinates turn the paths of each document into maximal spans.

Nothing is sampled and no count is bounded; equal edges agree in 96 bits of hash.  A minimizer with more than
``hot`` rows (a line that many documents share) is not brought together in one task: its edges are
counted where they are, the counts are added up, and joined back to the edges: broadcast if they are few, else in ``SALTS`` parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames as X
from . import words as W

HOT_KEYS = 100_000  # at most so many minimizers are broadcast as hot, the most frequent ones; each of the rest has no more than that share of all rows
HOT_EDGES = 500_000  # up to so many counts of hot edges (some 20 MB) are broadcast; more are joined in SALTS parts
SALTS = 64
_POS_BITS = 30
_POS = np.uint64((1 << _POS_BITS) - 1)


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries."""
    n, have = len(a) - width + 1, 1
    while have * 2 <= width:
        a = np.minimum(a[: len(a) - have], a[have:])
        have *= 2
    return np.minimum(a[:n], a[width - have : width - have + n])


def superkmers(text: pa.Array, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, word position, minimizer hash and first edge (with an end) of each run of edges with one minimizer; edge hashes."""
    w = W.words(text)
    at, edge = W.grams(w, length)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(1, np.int64), np.zeros(0, np.int32)
    k_at, k_hash = W.grams(w, k)
    order = np.full(len(w.hash) - k + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    order[k_at] = (k_hash & ~_POS) | (_POS - k_at.astype(np.uint64))  # of equal hashes the last one
    least = (_POS - (_window_min(order, length - k + 1)[at] & _POS)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    full = np.zeros(len(order), dtype=np.uint64)
    full[k_at] = k_hash
    row = w.row[at[first]]
    return row, at[first] - w.first[row], full[least[first]].view(np.int64), np.append(first, len(at)), edge.astype(np.uint32).view(np.int32)


def _emit(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi in W.chunks(text):
                row, pos, least, first, edge = superkmers(text.slice(lo, hi - lo), length, k)
                if len(row):
                    lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(edge))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(least), ids.slice(lo, hi - lo).take(pa.array(row)), pa.array(pos.astype(np.int32)), lists], ["least", "doc", "pos", "edges"]
                    )

    return run


def _cold(rows: DataFrame) -> DataFrame:
    """(least, doc, pos, at, places, docs, a, b): the edges that two documents have or more; each minimizer is brought together, once."""
    same, edge = Window.partitionBy("least"), Window.partitionBy("least", "edge")
    held = rows.repartition("least").withColumn("a", F.min("doc").over(same)).withColumn("b", F.max("doc").over(same)).where("a < b")
    unpacked = held.select("least", "doc", "pos", F.posexplode("edges").alias("i", "edge"))
    over = [F.count(F.lit(1)).over(edge).alias("places"), F.bit_xor(F.xxhash64("doc")).over(edge).alias("docs"), F.min("doc").over(edge).alias("a"), F.max("doc").over(edge).alias("b")]
    return unpacked.select("least", "doc", "pos", (F.col("pos") + F.col("i")).alias("at"), *over).where("a < b")


def _hot(rows: DataFrame, most: int = HOT_EDGES) -> DataFrame:
    """The same without bringing a minimizer together: counts of its edges are added up, and joined back."""
    edges = rows.select("least", "doc", "pos", F.posexplode("edges").alias("i", "edge"))
    stats = [F.count(F.lit(1)).alias("places"), F.bit_xor(F.xxhash64("doc")).alias("docs"), F.min("doc").alias("a"), F.max("doc").alias("b")]
    counts = X.written(edges.groupBy("least", "edge").agg(*stats).where("a < b"), "hot-edges")
    if counts.count() <= most:
        joined = edges.join(F.broadcast(counts), ["least", "edge"])
    else:
        salt = F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int")
        joined = edges.withColumn("salt", salt).join(counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["least", "edge", "salt"])
    return joined.select("least", "doc", "pos", (F.col("pos") + F.col("i")).alias("at"), "places", "docs", "a", "b")


def _runs(shared: DataFrame) -> DataFrame:
    """(doc, start, stop, places, path): consecutive edges of one minimizer and one set of occurrences."""
    runs = shared.groupBy("least", "doc", "pos", "places", "docs", "a", "b").agg(F.collect_set("at").alias("at"))
    ends = F.arrays_zip(
        F.array_sort(F.filter("at", lambda p: ~F.array_contains("at", p - 1))).alias("start"),
        F.array_sort(F.filter("at", lambda p: ~F.array_contains("at", p + 1))).alias("stop"),
    )
    return runs.select("doc", "places", F.xxhash64("places", "docs", "a", "b").alias("path"), F.explode(ends).alias("e")).select(
        "doc", F.col("e.start").alias("start"), F.col("e.stop").alias("stop"), "places", "path"
    )


def pieces(docs: DataFrame, length: int = 50, k: int = 25, hot: int = 50_000) -> DataFrame:
    """(doc, start, stop, places, path): runs of consecutive repeated edges of one minimizer and one set of occurrences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")
    rows = texts.mapInArrow(_emit(length, k), f"least long, doc {kind}, pos int, edges array<int>")
    often = rows.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    often = X.written(often.orderBy(F.desc("n"), "least").limit(HOT_KEYS).select("least"), "hot")
    if often.isEmpty():
        return _runs(_cold(rows))
    cold, warm = (rows.join(F.broadcast(often), "least", how) for how in ("left_anti", "left_semi"))
    return _runs(_cold(cold)).unionByName(_runs(_hot(warm)))


def paths(docs: DataFrame, length: int = 50, k: int = 25, hot: int = 50_000) -> DataFrame:
    """(doc, start, stop, places): whole nonbranching paths, each piece joined to the one that it continues."""
    p = X.written(pieces(docs, length, k, hot), "pieces")  # both sides of the join read them
    before = p.select("doc", (F.col("stop") + 1).alias("start"), "path", F.lit(True).alias("goes_on"))
    linked = p.join(before, ["doc", "start", "path"], "left")
    along = Window.partitionBy("doc").orderBy("start", "stop")
    return (
        linked.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "chain")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("places").alias("places"))
        .drop("chain")
    )


def repeated_spans(docs: DataFrame, length: int = 50, k: int = 25, hot: int = 50_000) -> DataFrame:
    """Maximal spans of words covered by runs of ``length`` words that stand in two documents or more.

    docs needs doc_id and text.  Returns (doc_id, start_word, end_word, n_places):
    the span is [start_word, end_word) in words (see ``words``), n_places the most
    places in which any of its runs stands.  Rows without doc_id or text are left
    out, texts shorter than ``length`` have no spans, rows that share a doc_id count
    as one document (a run that repeats only inside one is no repeat), other columns
    are ignored, an empty table gives an empty result.  doc_id may be of any type that can be ordered.
    """
    along = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    p = paths(docs, length, k, hot).select("doc", "start", (F.col("stop") + length).alias("end"), "places")
    spans = p.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc", "span").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.max("places").alias("n")).select(
        F.col("doc").alias("doc_id"), F.col("s").cast("long").alias("start_word"), F.col("e").cast("long").alias("end_word"), F.col("n").alias("n_places")
    )
