"""Groups of equal and nearly equal items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import shared


def exact_groups(items: DataFrame, key: str, digest: str) -> DataFrame:
    """(digest, first_id, n): groups of two or more items with one digest."""
    return items.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_summary(items: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: items, groups of duplicates, items in them and their share."""
    sizes = items.groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
    inside = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(total.alias("n_items"), F.count_if(F.col("n") > 1).alias("n_groups"), inside.alias("n_in_groups"), F.coalesce(F.try_divide(inside.cast("double"), total), F.lit(0.0)).alias("duplicate_fraction"))


def _hash_pairs(values: DataFrame, threshold: int, bits: int, block: int = 2048) -> DataFrame:
    """(h_a, h_b, distance): pairs of different hashes within the threshold, each once; values (h) has each hash once.

    Of threshold+1 bands two such hashes agree in one at least. Where bands tell apart more than 4,000 values on the whole, hashes meet
    in bands, and a pair counts in the first band that it shares; else bands would bring almost all pairs together many times, and all pairs are compared in blocks.
    """
    bands = threshold + 1
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    apart = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))).alias("distance")
    if min(b - a for a, b in zip(edges, edges[1:])) >= 12:
        band = F.array(*[F.struct(F.lit(i).alias("band"), F.col("h").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
        parts = values.select("h", F.explode(band).alias("b")).select("h", "b.band", "b.part")
        a, b = (parts.select(F.col("h").alias(f"h_{s}"), "band", "part") for s in "ab")
        pairs = a.join(b, ["band", "part"]).where("h_a < h_b")
        first = F.lit(bands)
        for i, m in reversed(list(enumerate(masks))):
            first = F.when(F.col("h_a").bitwiseAND(F.lit(m)) == F.col("h_b").bitwiseAND(F.lit(m)), F.lit(i)).otherwise(first)
        return pairs.where(first == F.col("band")).select("h_a", "h_b", apart).where(F.col("distance") <= threshold)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for same, x, y in zip(f.same, f.x, f.y):
                x, y = np.sort(np.asarray(x, np.int64)), np.sort(np.asarray(y, np.int64))
                for lo in range(0, len(x), 256):
                    d = np.bitwise_count((x[lo : lo + 256, None] ^ y[None, :]).view(np.uint64))
                    i, j = np.nonzero(d <= threshold)
                    i, j, d = x[lo + i], y[j], d[i, j].astype(np.int32)
                    keep = i < j if same else i != j
                    i, j, d = i[keep], j[keep], d[keep]
                    if len(i):
                        yield pd.DataFrame({"h_a": np.minimum(i, j), "h_b": np.maximum(i, j), "distance": d})

    n = max(1, min(-(-values.count() // block), 500))
    blocks = values.groupBy(F.pmod(F.xxhash64("h"), F.lit(n)).alias("k")).agg(F.collect_list("h").alias("hs"))
    x = blocks.select(F.col("k").alias("i"), F.col("hs").alias("x"), F.explode(F.sequence(F.col("k"), F.lit(n - 1).cast("long"))).alias("j"))
    met = x.join(blocks.select(F.col("k").alias("j"), F.col("hs").alias("y")), "j").select((F.col("i") == F.col("j")).alias("same"), "x", "y")
    return met.repartition(min(n * (n + 1) // 2, 2000)).mapInPandas(near, "h_a long, h_b long, distance int")


def _hashed(hashes: DataFrame, key: str, value: str) -> DataFrame:
    return hashes.select(F.col(key).alias("id"), F.col(value).cast("long").alias("h")).where("id is not null and h is not null")


def hamming_pairs(hashes: DataFrame, key: str, value: str, threshold: int = 10, bits: int = 64, chunk: int = 1000) -> DataFrame:
    """(id_a, id_b, distance): all pairs of 64-bit hashes within a Hamming distance.

    Only different hashes are compared; each pair of them then stands for all pairs of their items, which are written out from lists of up
    to ``chunk`` ids and not shuffled. A pair of ids that stands in the table several times comes out once.
    """
    h = _hashed(hashes, key, value).distinct().persist(StorageLevel.DISK_ONLY)
    values = h.select("h").distinct().persist(StorageLevel.DISK_ONLY)
    pairs = _hash_pairs(values, threshold, bits).unionByName(values.select(F.col("h").alias("h_a"), F.col("h").alias("h_b"), F.lit(0).alias("distance")))
    sizes = h.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    lists = h.join(sizes, "h").groupBy("h", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / chunk)).alias("c")).agg(F.collect_list("id").alias("ids"))
    a, b = (lists.select(F.col("h").alias(f"h_{s}"), F.col("c").alias(f"c_{s}"), F.col("ids").alias(f"ids_{s}")) for s in "ab")
    met = pairs.join(a, "h_a").join(b, "h_b").where("h_a != h_b or c_a <= c_b")
    met = met.repartition(int(h.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = met.select(((F.col("h_a") == F.col("h_b")) & (F.col("c_a") == F.col("c_b"))).alias("same"), "distance", F.explode("ids_a").alias("x"), "ids_b").select("same", "distance", "x", F.explode("ids_b").alias("y"))
    out = each.where("x < y or (x > y and not same)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.col("distance").cast("int").alias("distance"))
    repeated = h.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # ids with several hashes: their pairs may meet in several ways
    return out.distinct() if repeated.head(1) else out


def hamming_groups(hashes: DataFrame, key: str, value: str, threshold: int, bits: int = 64) -> DataFrame:
    """(seed, id): ``greedy_groups`` of items whose hashes are within the threshold, without their pairs.

    Items of one hash are taken together, as whoever takes the first of them takes all; so one stands for them, and they are joined to its group at the end.
    Should an id have several hashes, all pairs are made.
    """
    h = _hashed(hashes, key, value).distinct().persist(StorageLevel.DISK_ONLY)
    if h.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        return greedy_groups(h, hamming_pairs(h, "id", "h", threshold, bits), "id")
    first = h.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).persist(StorageLevel.DISK_ONLY)
    a, b = (first.select(F.col("h").alias(f"h_{s}"), F.col("first").alias(s)) for s in "ab")
    pairs = _hash_pairs(first.select("h"), threshold, bits).join(a, "h_a").join(b, "h_b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    seeds = _seeds(pairs)
    of = first.join(seeds, F.col("first") == F.col("id"), "left").select("h", F.coalesce("seed", "first").alias("seed"), "first", "n")
    # a group of one hash has no row in seeds, or only its own: it is one where it has two items
    size = of.groupBy("seed").agg(F.sum("n").alias("members")).where("members > 1")
    return h.join(of.join(size, "seed"), "h").select("seed", "id")


def _seeds(pairs: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(id, seed) of all items in pairs (id_a < id_b): an item seeds if no smaller neighbour does; else its seed is the smallest neighbour that does.

    Settled in rounds: an item without unsettled smaller neighbours seeds, and its neighbours do not. Every round takes what is settled out of the
    pairs; once there are only ``small`` of them, one task passes over them in order.
    """
    shared.checkpoints(pairs.sparkSession)
    edges = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().checkpoint()
    left, chosen, kind = edges, None, dict(edges.dtypes)["a"]

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(frames), ignore_index=True)
        f = f.sort_values(["a", "b"])
        taken: set = set()
        out = []
        for a, group in f.groupby("a", sort=True).b:
            if a not in taken:
                out.append(a)
                taken.update(group.tolist())
        seeding = set(out)
        out += [b for b in f.b.unique().tolist() if b not in taken and b not in seeding]
        yield pd.DataFrame({"s": pd.Series(out, dtype=f.a.dtype)})

    while True:
        if left.count() <= small:
            # an item whose smaller neighbours have all gone is an ``a`` only, or in no pair any more: the latter seeds, too
            rest = left.repartition(1).mapInPandas(last, f"s {kind}") if left.head(1) else left.select(F.col("a").alias("s"))
            chosen = rest if chosen is None else chosen.unionByName(rest)
            break
        free = left.select(F.col("a").alias("s")).distinct().join(left.select(F.col("b").alias("s")).distinct(), "s", "left_anti").checkpoint()
        chosen = free if chosen is None else chosen.unionByName(free)
        gone = free.join(left, F.col("s") == F.col("a")).select(F.col("b").alias("g")).unionByName(free.select(F.col("s").alias("g"))).distinct().checkpoint()
        kept = left.join(gone, F.col("a") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left_anti").checkpoint()
        # who lost all neighbours without being taken seeds
        every = left.select(F.col("a").alias("s")).unionByName(left.select(F.col("b").alias("s"))).distinct()
        alone = every.join(gone, F.col("s") == F.col("g"), "left_anti").join(kept.select(F.col("a").alias("k")).unionByName(kept.select(F.col("b").alias("k"))).distinct(), F.col("s") == F.col("k"), "left_anti")
        chosen, left = chosen.unionByName(alone).checkpoint(), kept
    chosen = chosen.distinct().checkpoint()
    near = edges.join(chosen, F.col("a") == F.col("s")).groupBy("b").agg(F.min("a").alias("seed")).select(F.col("b").alias("id"), "seed")
    return near.join(chosen, F.col("id") == F.col("s"), "left_anti").unionByName(chosen.select(F.col("s").alias("id"), F.col("s").alias("seed")))


def greedy_groups(items: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(seed, id): groups as a greedy pass in order of the ids makes them.

    The first item without a group seeds one and takes every later item near it that has
    none yet; members do not seed.  Items without neighbours, and seeds whose neighbours
    are all taken, are left out.
    """
    seeds = _seeds(pairs)
    size = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return seeds.join(size, "seed").select("seed", "id")


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): components of (a, b) by propagation of the least id, with pointer jumping, until nothing moves."""
    shared.checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root")).checkpoint()
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(near, F.col("id") == F.col("a"), "left").select("id", "root", F.least("root", F.coalesce("m", "root")).alias("next"))
        jump = new.select(F.col("id").alias("j"), F.col("next").alias("to"))
        new = new.join(jump, F.col("next") == F.col("j")).select("id", F.col("to").alias("next"), "root").checkpoint()
        label = new.select("id", F.col("next").alias("root"))
        if new.where("next != root").isEmpty():
            return label


def first_of_each(items: DataFrame, digest: str, key: str) -> DataFrame:
    w = Window.partitionBy(digest).orderBy(key)
    return items.withColumn("__n__", F.row_number().over(w)).where("__n__ = 1").drop("__n__")
