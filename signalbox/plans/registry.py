"""Registered queries and, where SQL can express them, their SQL over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under ``name`` with an optional equivalent SQL text."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals on the named columns, so both engines print the same number."""
    for name in columns:
        df = df.withColumn(name, F.round(F.col(name), 6))
    return df
