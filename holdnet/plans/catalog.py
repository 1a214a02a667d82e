"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from holdnet.plans.oracle_sql import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None, extra: list[tuple[str, str]] | None = None):
    """Register a query; ``sql`` (run after the fixture CTEs) is its oracle, if it has one."""
    def deco(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_fixtures(sql, extra)
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from holdnet.plans import graphs, hypothesis_plans, nodes, prediction, relations  # noqa: F401
