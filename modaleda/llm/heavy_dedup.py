"""Exact deduplication that keeps frequent digests out of the shuffle.

Misra-Gries summaries of the digests, merged in a tree, name every digest that can
stand for more than 1/(counters+1) of the rows.  One more pass over these counts
them exactly and finds their winners; the verified ones, at most ``counters``
rows, are broadcast, and their copies are dropped where they are read.  The rest
is shuffled by digest as usual, where no digest is hot any more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as X


def reduce_counters(c: Counter, counters: int) -> Counter:
    """The Misra-Gries step for many at once: subtracts the (counters+1)-largest count and drops what is left without."""
    if len(c) <= counters:
        return c
    cut = sorted(c.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in c.items() if v > cut})


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            weights = b.column(1).to_pylist() if b.num_columns > 1 else None
            if weights is None:
                counts = b.column(0).value_counts()
                keys, weights = counts.field("values").to_pylist(), counts.field("counts").to_pylist()
            else:
                keys = b.column(0).to_pylist()
            for k, v in zip(keys, weights):
                if k is not None:
                    c[k] += v
            if len(c) > 8 * counters:
                c = reduce_counters(c, counters)
        c = reduce_counters(c, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["digest", "n"])

    return run


def misra_gries(df: DataFrame, column: str, counters: int) -> list[str]:
    """Values of a string column, among them every one with more than 1/(counters+1) of the non-null rows."""
    s = df.select(column).mapInArrow(_summary(counters), "digest string, n long")
    parts = s.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 32)
        s = s.repartition(parts, F.spark_partition_id() % parts).mapInArrow(_summary(counters), "digest string, n long")
    return [r[0] for r in s.select("digest").collect()]


def digest() -> Column:
    return F.md5(F.col("text").cast("string"))


def _survivors(docs: DataFrame, counters: int) -> DataFrame:
    """Packed rows with digest and copies; rows of null text all stay, with no digest."""
    p = X.packed(docs, __doc__=F.col("doc_id"), __digest__=digest())
    keys = docs.select(digest().alias("__digest__"), F.col("doc_id").alias("__doc__"))
    heavy = misra_gries(keys, "__digest__", counters)
    by_id = F.col("__doc__").asc_nulls_last()
    mine = Window.partitionBy("__digest__")
    if heavy:
        spark = docs.sparkSession
        names = spark.createDataFrame([(h,) for h in heavy], "__digest__ string")
        winners = (
            keys.join(F.broadcast(names), "__digest__")
            .groupBy("__digest__")
            .agg(F.min("__doc__").alias("__winner__"), F.count(F.lit(1)).alias("__copies__"))
            .where("__copies__ > 1")
            .collect()
        )
        verified = spark.createDataFrame(winners, f"__digest__ string, __winner__ {docs.schema['doc_id'].dataType.simpleString()}, __copies__ long")
        p = p.join(F.broadcast(verified), "__digest__", "left").where("__copies__ is null or __winner__ <=> __doc__")
    else:
        p = p.withColumn("__copies__", F.lit(None).cast("long"))
    with_text = p.where("__digest__ is not null")
    ranked = with_text.withColumn("__n__", F.row_number().over(mine.orderBy(by_id))).withColumn("__copies__", F.coalesce("__copies__", F.count(F.lit(1)).over(mine)))
    kept = ranked.where("__n__ = 1").select(X.ROW, "__digest__", "__copies__")
    return kept.unionByName(p.where("__digest__ is null").select(X.ROW, "__digest__", F.lit(1).cast("long").alias("__copies__")))


def drop_copies(docs: DataFrame, counters: int = 256) -> DataFrame:
    """docs without rows whose text another row of smaller doc_id has.

    Of the rows with one text the one with the smallest doc_id stays (null ids count
    as the largest); of rows that agree in both just one stays.  A null text equals
    no other, so such rows stay; empty texts equal each other, and long ones are compared whole, by their MD5.  Returns the columns of
    docs, whatever their names; an empty table gives an empty one.
    """
    return X.unpacked(_survivors(docs, counters).select(X.ROW))


def kept_copies(docs: DataFrame, counters: int = 256) -> DataFrame:
    """(doc_id, digest, n_copies) of the rows that ``drop_copies`` keeps: the MD5 of the text, and how many rows have it.

    A row with a null text has a null digest and one copy; repeated rows are copies of each other, ties in doc_id leave one of them;
    other columns are ignored; an empty table gives an empty result.
    """
    k = _survivors(docs.select("doc_id", "text"), counters)
    return k.select(F.col(f"{X.ROW}.doc_id").alias("doc_id"), F.col("__digest__").alias("digest"), F.col("__copies__").alias("n_copies"))
