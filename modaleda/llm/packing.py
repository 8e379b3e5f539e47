"""Packing documents into training sequences by column generation.

Documents are cut to sequences of ``capacity`` tokens; what is left over of each is
a remainder.  The histogram of the remainders, in ``steps`` classes of length, is a
cutting-stock problem: the linear program over patterns of classes is solved by
the revised simplex method, and new patterns come from a knapsack (dynamic
programming) over the dual prices until none improves.  Solutions are rounded down
and the few remainders left are placed first-fit by decreasing length.  Documents,
ranked within their class, then take the places of the patterns in turn.  The
driver sees the histogram only, never documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as X
from . import ranks


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes 1..len(prices) within the capacity."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    sizes = np.arange(1, len(prices) + 1)
    for c in range(1, capacity + 1):
        n = min(c, len(prices))
        value = best[c - sizes[:n]] + prices[:n]
        i = int(np.argmax(value))
        best[c], take[c] = best[c - 1], 0
        if value[i] > best[c] + 1e-12:
            best[c], take[c] = value[i], i + 1
    pattern, c = np.zeros(len(prices), dtype=np.int64), capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def patterns(demand: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], float]:
    """(pattern, times) that hold the demand of sizes 1..len(demand) exactly; the LP's bound on the number of bins.

    Should the simplex method cycle, it stops after 200 steps a size at a solution that is feasible, and the bound is that solution's value.
    """
    used = np.flatnonzero(demand > 0)
    if not len(used):
        return [], 0.0
    sizes = used + 1
    m = len(used)
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(m)]
    inverse = np.diag([1.0 / columns[i][i] for i in range(m)])
    cost = np.ones(m)
    d = demand[used].astype(float)
    x = inverse @ d
    for _ in range(200 * m):
        y = cost @ inverse
        price = np.zeros(len(demand))
        price[used] = np.maximum(y, 0)
        value, whole = knapsack(price, capacity)
        entering, c = whole[used], 1.0
        if (worst := int(np.argmin(y))) is not None and y[worst] < -1e-9:  # surplus of a size enters
            entering, c = -np.eye(m, dtype=np.int64)[worst], 0.0
        elif value <= 1 + 1e-9:
            break
        step = inverse @ entering
        rising = step > 1e-10
        ratio = np.full(m, np.inf)
        ratio[rising] = x[rising] / step[rising]
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        inverse[out] /= step[out]
        for i in range(m):
            if i != out and step[i]:
                inverse[i] -= step[i] * inverse[out]
        columns[out], cost[out] = entering, c
    bound = float(cost @ np.maximum(x, 0))
    left = demand[used].copy()
    found: list[tuple[np.ndarray, int]] = []
    for col, c, n in zip(columns, cost, np.floor(x + 1e-7).astype(np.int64)):
        if c and n > 0:
            n = min(int(n), *(int(left[i] // col[i]) for i in np.flatnonzero(col)))
            if n > 0:
                left -= n * col
                found.append((col, n))
    bins: list[list] = []
    for i in range(m - 1, -1, -1):  # what rounding left: first fit, longest first
        for _ in range(int(left[i])):
            for b in bins:
                if b[0] >= sizes[i]:
                    break
            else:
                bins.append(b := [capacity, np.zeros(m, dtype=np.int64)])
            b[0] -= sizes[i]
            b[1][i] += 1
    merged: dict[tuple, int] = {}
    for col, n in [*found, *((b[1], 1) for b in bins)]:
        merged[tuple(col)] = merged.get(tuple(col), 0) + n
    out_list = []
    for col, n in merged.items():
        full = np.zeros(len(demand), dtype=np.int64)
        full[used] = col
        out_list.append((full, n))
    return out_list, bound


def classes_for(capacity: int, steps: int) -> tuple[int, int]:
    """Tokens that one unit of length stands for, and how many units a sequence holds: ``steps`` at most."""
    unit = -(-capacity // steps)
    return unit, capacity // unit


def packed_sequences(docs: DataFrame, capacity: int = 2048, steps: int = 64, seed: str = "pack", length: Column | None = None) -> DataFrame:
    """(sequence, doc_id, doc_start, n_tokens): which tokens of which document each training sequence holds.

    docs needs doc_id and text; tokens are runs of non-white characters, unless ``length`` counts them.  capacity
    and steps are any numbers from 1 up.  A document of
    n tokens gives n // capacity whole sequences and, unless that comes out even, a
    remainder, which shares a sequence with others.  No sequence holds more than
    ``capacity`` tokens and every token is in just one place.  Sequences that hold
    remainders are numbered from 0; whole ones have negative numbers -1, -2, ... in
    the order of the documents.  Documents are ranked by a seeded hash of their
    doc_id, then by doc_id and text (nulls first; equal rows are interchangeable).
    Null texts and texts without tokens take no place; rows that repeat are packed
    each by itself; texts of any length are packed whole; other columns are ignored; an empty table gives an empty result.
    """
    if capacity < 1 or steps < 1:
        raise ValueError("capacity and steps begin at 1")
    unit, steps = classes_for(capacity, steps)
    text = F.col("text").cast("string")
    docs_ = docs.select(
        F.col("doc_id"),
        text.alias("text"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")) if length is None else length, F.lit(0)).cast("long").alias("n"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("h"),
    )
    rows = X.written(docs_.where("n > 0").select("doc_id", "n", "h", F.xxhash64("text").alias("t")), "lengths")
    rows = rows.withColumn("rest", F.col("n") % capacity).withColumn("whole", F.floor(F.col("n") / capacity).cast("long"))
    rests = rows.where("rest > 0").withColumn("size", F.least(F.ceil(F.col("rest") / unit), F.lit(steps)).cast("int")).withColumn("one", F.lit(1).cast("long"))
    # a remainder of the last class has a sequence of its own, in which the odd tokens beyond the last unit fit as well
    demand = np.zeros(steps, dtype=np.int64)
    for r in rests.groupBy("size").count().collect():
        demand[r[0] - 1] = r[1]
    found, _ = patterns(demand, steps)
    taken, first_bin, slots = np.zeros(steps, dtype=np.int64), 0, []
    for pattern, times in found:
        for i in np.flatnonzero(pattern):
            slots.append((int(i + 1), int(taken[i]), int(taken[i] + pattern[i] * times), int(pattern[i]), first_bin))
            taken[i] += pattern[i] * times
        first_bin += times
    spark = docs.sparkSession
    by_size = spark.createDataFrame(slots, "size int, lo long, hi long, each long, bin long").groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "each", "bin"))).alias("slots"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("t")]
    ranked = ranks.running_sum(rests, "size", order, "h", "one", "rank", ranks.digits_for(int(demand.max())))
    slot = F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    shared = ranked.join(by_size, "size").withColumn("s", slot).select(
        (F.col("s.bin") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.each"))).cast("long").alias("sequence"),
        "doc_id", (F.col("n") - F.col("rest")).alias("doc_start"), F.col("rest").alias("n_tokens"),
    )
    longs = rows.where("whole > 0")
    longs = ranks.running_sum(longs.withColumn("all", F.lit(0)), "all", order, "h", "whole", "before", ranks.digits_for(longs.count()))
    whole = longs.select("doc_id", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("i")).select(
        (-(F.col("before") + F.col("i")) - 1).alias("sequence"), "doc_id", (F.col("i") * capacity).alias("doc_start"), F.lit(capacity).cast("long").alias("n_tokens")
    )
    return shared.unionByName(whole)
