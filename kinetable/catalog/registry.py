"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin over the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_tables(*parts: str) -> str:
    """WITH clause made of adapter fragments."""
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def r6(name: str, out: str | None = None) -> Column:
    """Round a computed double to six places, halves away from zero, as DuckDB does.

    Plain double arithmetic: ``round`` would go through a decimal object per value.
    """
    value = F.col(name).cast("double")
    return (F.signum(value) * F.floor(F.abs(value) * 1e6 + 0.5) / 1e6).alias(out or name)
