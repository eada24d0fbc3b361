"""All registered queries and their DuckDB texts.

A query is registered with @query(name, sql); the modules in _MODULES are imported once, below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame; sql is the same query for DuckDB, where SQL has one."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["f3_budget_cut"](spark, sf_dir)


from tessella.plans import (  # noqa: E402, F401  the modules register their queries
    ranking,
    relational,
    texts,
    rules,
    topics,
    archives,
    composing,
    resolving,
    reading,
)
