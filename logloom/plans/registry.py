"""Registry of named queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MILLIS = "yyyy-MM-dd HH:mm:ss.SSS"


def query(name: str, oracle: str | None = None):
    """Register a query; without an oracle only its rows are checked."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def stamp(column: str | Column, name: str | None = None) -> Column:
    """Millisecond text of an instant, comparable across engines."""
    col = F.col(column) if isinstance(column, str) else column
    return F.date_format(col, MILLIS).alias(name or column)


def sql_stamp(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%g') AS {name or expression}"
