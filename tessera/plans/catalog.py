"""Queries over the driver's tables by name, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import engine_queries, evaluation_queries, lifecycle_queries, retrieval_queries, service_queries, text_queries

_PARTS = (text_queries, retrieval_queries, evaluation_queries, lifecycle_queries, service_queries, engine_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
