"""Recursive queries with UNION: a fix-point in Spark rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.errors import ExecutionError

MOST_ROUNDS, MOST_ROWS = 1000, 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or a temporary folder in local sessions that set none."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ExecutionError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessella-")


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = MOST_ROUNDS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows of ``base`` and of ``step`` applied to the rows that are new, again and again; each row once.

    Each round is written to the shared folder, which cuts the lineage and survives lost executors.
    """
    spark, names = base.sparkSession, base.columns
    folder, rounds, total = f"{shared_folder(spark)}/fixpoint-{uuid.uuid4().hex}", [], 0
    new = base.distinct()
    for r in range(most_rounds + 1):
        path = f"{folder}/{r}"
        new.write.parquet(path)
        new = spark.read.schema(new.schema).parquet(path)
        if (count := new.count()) == 0:
            break
        total += count
        if r == most_rounds or total > most_rows:
            raise ExecutionError(f"a recursive query goes beyond {most_rounds} rounds or {most_rows} rows")
        rounds.append(path)
        every = spark.read.schema(base.schema).parquet(*rounds)
        grown = step(new).toDF(*names)
        new = grown.select(*[grown[f.name].cast(f.dataType).alias(f.name) for f in base.schema]).distinct().exceptAll(every)
    return spark.read.schema(base.schema).parquet(*rounds) if rounds else base.limit(0)
