"""Where the modalities register their queries, each with SQL for the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (table reader -> DataFrame) under its name."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def stats_sql(source: str, metrics: list[str], by: str = "", digits: int = 6) -> str:
    """SQL for core.stats.describe over ``source`` (a query with the metrics as columns)."""
    r = lambda x: f"round(({x})::double, {digits})"
    head, tail = (f"{by}, ", f" group by {by}") if by else ("", "")
    rows = [
        f"select {head}'{m}' as metric, count({m})::bigint as count, {r(f'avg({m})')} as mean, {r(f'stddev_pop({m})')} as std, {r(f'min({m})')} as min, "
        f"{r(f'quantile_cont({m}::double, 0.25)')} as p25, {r(f'quantile_cont({m}::double, 0.5)')} as median, {r(f'quantile_cont({m}::double, 0.75)')} as p75, {r(f'max({m})')} as max from r{tail}"
        for m in metrics
    ]
    return f"with r as ({source}) " + " union all ".join(rows)


def col(name: str) -> Column:
    return F.col(name)
