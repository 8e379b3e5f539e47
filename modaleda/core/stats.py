"""Dataset aggregates: distribution statistics, frequency tables, histograms, deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("count", "mean", "std", "min", "p25", "median", "p75", "max")


def finite(c: Column) -> Column:
    """The value as a double, and null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def stat_columns(c: Column, prefix: str = "", digits: int | None = None) -> list[Column]:
    """Exact count, mean, population deviation, extremes and linearly interpolated quartiles of the finite values."""
    v = finite(c)
    out = {
        "count": F.count(v), "mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v),
        "p25": F.percentile(v, 0.25), "median": F.percentile(v, 0.5), "p75": F.percentile(v, 0.75), "max": F.max(v),
    }
    return [(x if k == "count" or digits is None else F.round(x, digits)).alias(prefix + k) for k, x in out.items()]


def stat_struct(c: Column, digits: int | None = None) -> Column:
    return F.struct(*stat_columns(c, "", digits))


def describe(df: DataFrame, metrics: list[str], by: list[str] | None = None, digits: int | None = 6) -> DataFrame:
    """One row of statistics for each metric (and group), from one aggregation over all metrics at once."""
    by = by or []
    wide = df.groupBy(*by).agg(*[stat_struct(F.col(m), digits).alias(m) for m in metrics])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in metrics])).alias("r")
    return wide.select(*by, rows).select(*by, "r.metric", "r.s.*")


def frequency(df: DataFrame, key: str, drop_null: bool = True) -> DataFrame:
    """(key, count)."""
    return (df.where(F.col(key).isNotNull()) if drop_null else df).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def imbalance(df: DataFrame, key: str) -> DataFrame:
    """One row: the largest class count over the smallest, and the number of classes."""
    return frequency(df, key).agg(F.count(F.lit(1)).alias("n_classes"), F.try_divide(F.max("count").cast("double"), F.min("count")).alias("imbalance_ratio"))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None, log10: bool = False) -> DataFrame:
    """(bin, lo, hi, count) of equal-width bins over [min, max], the last one closed; bins without values are left out.

    A constant is spread over one unit around it, as usual.  With log10 it is the logarithms of the positive values that are binned.
    """
    by = by or []
    v = df.select(*by, (F.log10(F.when(finite(F.col(value)) > 0, finite(F.col(value)))) if log10 else finite(F.col(value))).alias("v")).where("v is not null")
    ends = v.groupBy(*by).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = ends.select(*by, F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    both = v.join(F.broadcast(ends), by) if by else v.crossJoin(F.broadcast(ends))  # one row of bounds
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor((F.col("v") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    return (
        both.groupBy(*by, at.alias("bin"), "a", "b")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(*by, "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "count")
    )


def text_bins(n: int) -> int:
    """Number of bins for n values of a text metric."""
    return min(30, max(5, int(n**0.5) + 1))


def sample_per_group(df: DataFrame, group: str, order: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, the same ones each time: those of the least seeded hash."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), order), order)
    return df.withColumn("__n__", F.row_number().over(w)).where(F.col("__n__") <= n).drop("__n__")


def zscore(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics less their mean over their population deviation (1 where that is 0); null and non-finite values count as 0."""
    filled = df.select("*", *[F.coalesce(finite(F.col(m)), F.lit(0.0)).alias(f"__{m}") for m in metrics])
    moments = filled.agg(*[F.avg(f"__{m}").alias(f"__a_{m}") for m in metrics], *[F.stddev_pop(f"__{m}").alias(f"__s_{m}") for m in metrics])
    both = filled.crossJoin(F.broadcast(moments))  # one row of moments
    scaled = {m: (F.col(f"__{m}") - F.col(f"__a_{m}")) / F.when(F.col(f"__s_{m}") == 0, 1.0).otherwise(F.col(f"__s_{m}")) for m in metrics}
    return both.select(*[c for c in df.columns if c not in metrics], *[scaled[m].alias(m) for m in metrics])


def percentile_clip(df: DataFrame, value: str, out: str, lo: float = 2, hi: float = 98) -> DataFrame:
    """df with ``out``: the value clipped to its lo-th and hi-th percentile and scaled to 0-1 (0 where these are equal); null and non-finite values give null."""
    v = finite(F.col(value))
    ends = df.agg(F.percentile(v, lo / 100).alias("__lo"), F.percentile(v, hi / 100).alias("__hi"))
    both = df.crossJoin(F.broadcast(ends))  # one row of bounds
    width = F.col("__hi") - F.col("__lo")
    clipped = F.when(v.isNotNull(), F.least(F.greatest(v, F.col("__lo")), F.col("__hi")))
    return both.withColumn(out, F.when(width == 0, F.when(v.isNotNull(), F.lit(0.0))).otherwise(F.try_divide(clipped - F.col("__lo"), width))).drop("__lo", "__hi")


def rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """(flag, count, fraction) of boolean columns over all rows; null counts as false."""
    n = F.count(F.lit(1))
    one = F.struct(*[F.struct(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias("count"), F.coalesce(F.try_divide(F.count_if(F.coalesce(F.col(f), F.lit(False))).cast("double"), n), F.lit(0.0)).alias("fraction")).alias(f) for f in flags]).alias("s")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"s.{f}.count").alias("count"), F.col(f"s.{f}.fraction").alias("fraction")) for f in flags])).alias("r")
    return df.agg(one).select(each).select("r.*")


def vector_means(df: DataFrame, vectors: dict[str, list[str]]) -> DataFrame:
    """(vector, component, mean, std) over the rows, element by element; the vectors are lists of columns."""
    names = [c for cs in vectors.values() for c in cs]
    wide = df.agg(*[F.struct(F.avg(finite(F.col(c))).alias("mean"), F.stddev_pop(finite(F.col(c))).alias("std")).alias(c) for c in names])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("vector"), F.lit(i).alias("component"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std")) for v, cs in vectors.items() for i, c in enumerate(cs)])).alias("r")
    return wide.select(each).select("r.*")
