"""Mixing sources to target weights by Sainte-Lague apportionment.

The documents of a source, in a seeded order, are cut into blocks of equal numbers
of tokens (a document belongs to the block in which its first token lies).  A
shard holds ``blocks_per_shard`` blocks; they are seats, which go to the sources
with the highest quotients weight / (2 seats + 1), so that every shard has the same
integer quota of each source.  As many shards are made as the sources that hold the share ``holding`` of
the seats can fill; the others give all that they have, so that a tiny source doesn't hold up the rest.  Which blocks of a
source are taken, and for which shard, is a seeded permutation of its block numbers, computed row by row.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as X
from . import ranks

STRIDE_BITS, BLOCK_BITS = 22, 40  # their product stays within 63 bits


def sainte_lague(weights: dict[str, float], seats: int) -> dict[str, int]:
    """Seats of each source; of equal quotients the one of the smaller name is first."""
    out = {s: 0 for s in weights}
    heap = [(-Fraction(w), s) for s, w in weights.items() if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, s = heapq.heappop(heap)
        out[s] += 1
        heapq.heappush(heap, (-Fraction(weights[s]) / (2 * out[s] + 1), s))
    return out


def stride_of(source: str, blocks: int, seed: str) -> int:
    """A number without a factor in common with blocks, so that its multiples permute the block numbers."""
    low = min(blocks, 1 << STRIDE_BITS) // 3
    at = 1 + low + int(hashlib.md5(f"{seed}:stride:{source}".encode()).hexdigest()[:8], 16) % (low + 1)
    while math.gcd(at, blocks) > 1:
        at += 1
    return at


def shards_for(fills: list[tuple[int, int]], seats: int, holding: float) -> int:
    """The greatest number of shards that sources of the share ``holding`` of the seats can fill, of (shards that a source can fill, its quota); 1 at least."""
    had = 0
    for fill, quota in sorted(fills, reverse=True):
        had += quota
        if had >= holding * seats:
            return max(1, fill)
    return 1


def _prepared(docs: DataFrame, seed: str, length: Column | None) -> DataFrame:
    text = F.col("text").cast("string")
    return X.packed(
        docs,
        __source__=F.coalesce(F.col("source").cast("string"), F.lit("")),
        __tokens__=F.coalesce(F.regexp_count(text, F.lit(r"\S+")) if length is None else length, F.lit(0)).cast("long"),
        __hash__=F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))),
        __doc__=F.col("doc_id"),
        __tie__=F.md5(text),
    )


def _plan(totals: dict[str, int], weights: dict[str, float] | None, power: float, block_tokens: int, blocks_per_shard: int, holding: float, seed: str) -> list[tuple[str, int, int, int, int]]:
    """(source, blocks, quota, shards, stride) of the sources that have a seat."""
    blocks = {s: -(-max(t, 1) // block_tokens) for s, t in totals.items()}
    if blocks and max(blocks.values()) >> BLOCK_BITS:
        raise ValueError(f"a source has more than 2**{BLOCK_BITS} blocks; take larger blocks")
    given = {s: float(weights.get(s, 0)) for s in totals} if weights else {s: round(t**power, 6) for s, t in totals.items()}
    quota = {s: q for s, q in sainte_lague(given, blocks_per_shard).items() if q}
    shards = shards_for([(blocks[s] // q, q) for s, q in quota.items()], sum(quota.values()), holding)
    return [(s, blocks[s], q, shards, stride_of(s, blocks[s], seed)) for s, q in quota.items()]


def slot_of(block: Column, blocks: Column, stride: Column, shift: Column) -> Column:
    """The place of a block in the seeded permutation of its source's blocks."""
    return (block * stride + shift) % blocks


def _chosen(docs: DataFrame, weights, power, block_tokens, blocks_per_shard, seed, holding, length) -> DataFrame:
    rows = _prepared(docs, seed, length)
    slim = rows.select("__source__", "__tokens__", "__hash__")
    by_source = slim.groupBy("__source__").agg(F.sum("__tokens__"), F.count(F.lit(1))).collect()
    plan = _plan({r[0]: r[1] for r in by_source}, weights, power, block_tokens, blocks_per_shard, holding, seed)
    plan = docs.sparkSession.createDataFrame(plan, "__s__ string, __blocks__ long, __quota__ long, __shards__ long, __stride__ long")
    digits = ranks.digits_for(max((r[2] for r in by_source), default=0))
    placed = ranks.running_sum(rows, "__source__", [F.col("__doc__").asc_nulls_first(), F.col("__tie__").asc_nulls_first()], "__hash__", "__tokens__", "__start__", digits, slim)
    placed = placed.join(plan, F.col("__source__") == F.col("__s__"))
    block = F.least(F.floor(F.col("__start__") / block_tokens).cast("long"), F.col("__blocks__") - 1)
    shift = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "__source__")), 1, 8), 16, 10).cast("long"), F.col("__blocks__"))
    return (
        placed.withColumn("__block__", block)
        .withColumn("__slot__", slot_of(F.col("__block__"), F.col("__blocks__"), F.col("__stride__"), shift))
        .where(F.col("__slot__") < F.col("__quota__") * F.col("__shards__"))
        .withColumn("__shard__", F.floor(F.col("__slot__") / F.col("__quota__")).cast("long"))
    )


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block_tokens: int = 256, blocks_per_shard: int = 256, seed: str = "mix", holding: float = 0.9, length: Column | None = None
) -> DataFrame:
    """The rows of docs that fall into chosen blocks, with the columns of docs alone; they are shuffled once, whole.

    Nulls, empty and long texts, ties, repeated rows and an empty table are treated as in ``assignments``.
    """
    return X.unpacked(_chosen(docs, weights, power, block_tokens, blocks_per_shard, seed, holding, length).select(X.ROW))


def assignments(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, block_tokens: int = 256, blocks_per_shard: int = 256, seed: str = "mix", holding: float = 0.9, length: Column | None = None
) -> DataFrame:
    """(doc_id, source, block, shard, n_tokens) of the chosen documents.

    docs needs doc_id, text and source.  Without ``weights`` (source to weight; others
    get none) a source weighs as its tokens to the given power.  Tokens are runs of
    non-white characters, unless ``length`` counts them; texts of any length count whole, and a long one belongs
    to the block in which it begins.  A null source is the source "", a null text has no tokens,
    null doc_ids share one place in the order; ties are broken by the text's digest, and rows that
    agree in all are interchangeable.  A source whose weight earns no seat in a shard
    is left out; a source that runs out gives what it has.  An empty table gives an empty result.
    Texts are not shuffled, only their lengths and digests.
    """
    slim = docs.select("doc_id", "text", "source")
    c = _chosen(slim, weights, power, block_tokens, blocks_per_shard, seed, holding, length)
    return c.select(F.col("__doc__").alias("doc_id"), F.col("__source__").alias("source"), F.col("__block__").alias("block"), F.col("__shard__").alias("shard"), F.col("__tokens__").alias("n_tokens"))
