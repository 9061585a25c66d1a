"""Registry of the checked queries: one Spark builder and (when SQL can say it)
one DuckDB oracle per operator id of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def r4(expr: str) -> str:
    """SQL side of ``scalars.oracle_round``."""
    return f"round(({expr}) + 3.3e-7, 4)"


def load_all() -> None:
    """Import every query module so that its queries register."""
    from demandspark.plans import (  # noqa: F401
        q_prepare, q_stats, q_clean, q_profile, q_cluster, q_forecast, q_api, q_props)
