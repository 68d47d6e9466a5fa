"""All queries of the core, with their equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans import document_queries, nested_queries, star_queries, stream_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return document_queries.QUERIES | nested_queries.QUERIES | stream_queries.QUERIES | star_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return document_queries.SQL | stream_queries.SQL | star_queries.SQL
