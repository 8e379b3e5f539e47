"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__packed_row__"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns, and the whole row as one struct that no column name can clash with."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.  Where it is unset, a local session (tests) gets one of our own; a cluster has no such place, and is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file:/tmp/modaleda-checkpoint"
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and losing an executor loses nothing.

    What ``dropped`` doesn't remove before goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _scopes:
        made.append(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df by key in as many partitions as the session shuffles into, for work that takes much time a byte: adaptive planning would merge them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Yields ``written`` for what is to stay; all other tables that are written inside go at the end."""
    made, kept = [], []
    _scopes.append(made)

    def keep(df: DataFrame, what: str) -> DataFrame:
        out = written(df, what)
        kept.append(made[-1])
        return out

    try:
        yield keep
    finally:
        _scopes.remove(made)
        for path in set(made) - set(kept):
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def first_of(df: DataFrame, *key: str) -> DataFrame:
    """One row of each key; rows of a hot key are thinned before the shuffle."""
    return df.withColumn("__nth__", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).where("__nth__ = 1").drop("__nth__")


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that ``written`` made, once nothing reads them any more."""
    for df in tables:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            _remove(df.sparkSession, f)


def sieve(kept: DataFrame, most: int = 1 << 25) -> Callable[..., Column] | None:
    """A test of whether a row's key may be among the rows of kept (where each stands once): a function of the key's columns, given in the order of those of kept.

    A bitmap of 16 places for each key is tested, so one of 16 other rows slips through; a join must decide.
    Beyond ``most`` keys, where the bitmap would take more than 64 MB, there is None: the join then has to shuffle all rows.
    """
    n = kept.count()
    if n > most:
        return None
    places = 16 * max(n, 1)

    def place(*key: Column | str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(places)) + 1

    parts = kept.select(place(*kept.columns).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    size = 4096  # bytes of a part
    bits = np.zeros((places // (8 * size) + 1) * size, dtype=np.uint8)
    for r in parts:
        bits[(r.b - 1) * size : r.b * size] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = kept.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        at = p.to_numpy() - 1
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda *key: there(place(*key))


LONG = T.LongType()
