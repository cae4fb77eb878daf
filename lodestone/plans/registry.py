"""All queries of the evidence engine and the relational surface, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import dialect, evidence, relational, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (reports, relational, evidence, dialect):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
