"""All core queries by name, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import core_problems, interval_queries, join_queries, model_queries, scoring_queries, series_queries, stream_queries, vector_queries

FAMILIES = (series_queries, join_queries, interval_queries, scoring_queries, model_queries, stream_queries, vector_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = dict(core_problems.QUERIES)
    for f in FAMILIES:
        found |= f.query.queries
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(core_problems.ORACLES)
    for f in FAMILIES:
        found |= f.query.oracles
    return found
