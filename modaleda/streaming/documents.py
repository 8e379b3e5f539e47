"""The text records of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import text


def document_records(spark: SparkSession, path: str, schema: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A stream of one record for each document of the Parquet files that come into the folder; no state is kept."""
    return text.records(spark.readStream.schema(schema).parquet(path), keep=keep)
