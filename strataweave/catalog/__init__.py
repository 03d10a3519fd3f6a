"""Registered queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    """Import the modules that register queries."""
    from strataweave.catalog import composites, relational, sampling, spatial, statistics  # noqa: F401
