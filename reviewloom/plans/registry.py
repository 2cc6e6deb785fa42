"""The registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are checked."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def rounded(number: Column | str) -> Column:
    """Six digits; adding zero turns a negative zero into a plain one."""
    return F.round(number, 6) + F.lit(0.0)


def long_vectors(rows: DataFrame, keys: list[str], vector: str, value: str = "value") -> DataFrame:
    """One row per component, with its place ``dim``."""
    exploded = rows.select(*keys, F.posexplode(vector).alias("dim", "_x"))
    return exploded.select(*keys, "dim", rounded("_x").alias(value))
