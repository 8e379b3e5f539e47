"""The folder that all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, set as the place of checkpoints.  Where it is unset, a local session (tests) gets a folder of our own; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file:/tmp/modaleda-checkpoint"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where
