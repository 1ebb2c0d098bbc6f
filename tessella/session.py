"""Session construction and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Settings that fix semantics or let the optimizer re-plan at run time.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session or build a local one with the library's defaults.

    On a cluster the session already exists, so ``DEFAULTS`` only fill what local runs need.
    """
    if (active := SparkSession.getActiveSession()) is not None and not conf and master is None:
        return active
    builder = SparkSession.builder.appName(app).master(master or os.environ.get("SPARK_MASTER", "local[*]"))
    for key, value in ({"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
