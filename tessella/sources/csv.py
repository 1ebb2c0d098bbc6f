"""CSV import and export with the dialect's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.library import cast_to


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, delimiter: str = ",") -> tuple[DataFrame, int]:
    """Typed rows of a CSV file, and how many were refused because a NOT NULL column is null.

    Cells that can't be converted, missing cells and empty ones are null; cells beyond the schema are cut.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.csv(path, schema=text, header=header, sep=delimiter, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", enforceSchema=True, nullValue="")
    typed = raw.select(*[F.expr(cast_to(f"`{f.name}`", f.dataType.simpleString())).alias(f.name) if f.dataType != T.StringType() else F.col(f.name) for f in schema])
    needed = [f.name for f in schema if not f.nullable]
    if not needed:
        return typed, 0
    whole = F.lit(True)
    for name in needed:
        whole &= F.col(name).isNotNull()
    return typed.where(whole), typed.where(~whole).count()


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """Write CSV with ISO dates, true and false, and empty cells for nulls; one file for each partition, as Spark does."""
    shown = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema])
    shown.write.mode("overwrite").csv(path, header=header, sep=delimiter, quote='"', escape='"', nullValue="", emptyValue="")
