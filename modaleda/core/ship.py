"""Makes this package importable by the Python workers of a session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once; Spark brings it to the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    with tempfile.TemporaryDirectory() as staging:
        shutil.copytree(root / "modaleda", Path(staging, "in", "modaleda"), ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp(), f"modaleda-{app}")), "zip", Path(staging, "in"))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
