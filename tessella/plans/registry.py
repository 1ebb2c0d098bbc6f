"""How queries are registered: SQL of the dialect or a function, and DuckDB SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.engine import Engine
from tessella.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine_for(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """An engine with the tables that ``sql`` names."""
    engine = Engine(spark)
    for name in set(re.findall(r"[a-z_]+", sql.lower())) & set(TABLES):
        engine.register(name, table(spark, sf_dir, name))
    return engine


class Registry:
    def __init__(self) -> None:
        self.made: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query of the dialect; without an oracle of its own, DuckDB reads the same text."""
        self.made[name] = (lambda spark, sf_dir: engine_for(spark, sf_dir, text).query(text)), oracle or text

    def function(self, name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
        self.made[name] = run, oracle

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        return {k: v[0] for k, v in self.made.items()}

    def oracles(self) -> dict[str, str]:
        return {k: v[1] for k, v in self.made.items() if v[1]}
