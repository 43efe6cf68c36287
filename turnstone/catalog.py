"""All queries of the engine by name, and the SQL that each must agree with.

A query adapts the driver's tables to an operator's input and names its columns. Plans register
themselves here; `load` imports them all.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PLANS = ("lexical", "archive", "timeline", "vectors", "graph", "candidates", "communities", "entities", "lifecycle", "chronos", "reconcile", "streams", "records", "store", "retrieval", "maintenance", "admission", "queue", "imports", "files")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql is what DuckDB answers it with, None where SQL can't."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for name in PLANS:
        import_module(f"turnstone.plans.{name}")
