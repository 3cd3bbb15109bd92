"""All queries of the core, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import compaction_queries, text_queries, token_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**text_queries.QUERIES, **token_queries.QUERIES, **compaction_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    try:
        tokens = token_queries.sql_queries()
    except FileNotFoundError:  # without the public tokenizer files there is no small vocabulary to spell out
        tokens = {}
    return {**text_queries.SQL, **tokens, **compaction_queries.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return token_queries.flagship(spark, d)
