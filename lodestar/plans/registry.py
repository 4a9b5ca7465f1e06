"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import (
    detail_queries, file_queries, language_queries, lifecycle_queries, observation_queries, record_queries, search_queries, state_queries, text_queries, version_queries, work_queries,
)

_ALL = {
    **state_queries.QUERIES, **search_queries.QUERIES, **record_queries.QUERIES, **text_queries.QUERIES, **observation_queries.QUERIES, **work_queries.QUERIES, **lifecycle_queries.QUERIES, **file_queries.QUERIES, **language_queries.QUERIES, **version_queries.QUERIES, **detail_queries.QUERIES,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
