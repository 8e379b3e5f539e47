"""Running sums over large groups without one task for each group.

Rows of a group are ordered by a hash; its leading hex digits name a bucket.  So many digits are taken
that a bucket of the largest group holds about ``BUCKET_ROWS`` rows.  Totals of the buckets are
summed up first, and the running sum within a bucket is added to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 50_000


def digits_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits that split so many rows into buckets of about bucket_rows."""
    return max(1, math.ceil(math.log(max(rows, 1) / bucket_rows, 16))) if rows > bucket_rows else 1


def running_sum(rows: DataFrame, group: str, order: list[Column], hexed: str, amount: str, out: str, digits: int, totals_of: DataFrame | None = None) -> DataFrame:
    """rows with ``out``: the sum of ``amount`` over the rows of the same group that come before, in order of the hex string ``hexed``, then ``order``."""
    bucket = F.substring(hexed, 1, digits)
    totals = (rows if totals_of is None else totals_of).groupBy(F.col(group).alias("__g__"), bucket.alias("__b__")).agg(F.sum(amount).alias("__t__"))
    before = Window.partitionBy("__g__").orderBy("__b__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__o__", F.coalesce(F.sum("__t__").over(before), F.lit(0))).drop("__t__")
    local = Window.partitionBy(group, "__b__").orderBy(F.col(hexed), *order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("__b__", bucket).withColumn("__s__", F.coalesce(F.sum(amount).over(local), F.lit(0)))
    joined = within.join(offsets.withColumnRenamed("__b__", "__b2__"), (F.col(group) == F.col("__g__")) & (F.col("__b__") == F.col("__b2__")))
    return joined.withColumn(out, F.col("__o__") + F.col("__s__")).drop("__g__", "__b__", "__b2__", "__s__", "__o__")
