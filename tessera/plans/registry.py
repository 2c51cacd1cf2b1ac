"""All queries of the library's own operators over the driver tables, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _name in ("analytics", "resolution", "documents", "exam", "sessions", "workbooks", "evidence", "projections"):
    _module = importlib.import_module(f"tessera.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
