"""All registered queries, gathered from the catalogue modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import programs, relational, scalars

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return relational.QUERIES.queries() | scalars.QUERIES.queries() | programs.QUERIES.queries()


def oracle_sql() -> dict[str, str]:
    return relational.QUERIES.oracles() | scalars.QUERIES.oracles() | programs.QUERIES.oracles()
