"""All queries of the analytics operators, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from .plans import array_queries, summary_queries, text_queries  # noqa: F401 - they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
