"""Mergeable sketches by built-in aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sketch(column: str, lg_k: int = 12) -> Column:
    """A HyperLogLog sketch that ``distinct_estimate(merge_distinct(...))`` reads and merges."""
    return F.hll_sketch_agg(column, F.lit(lg_k))


def merge_distinct(column: str) -> Column:
    return F.hll_union_agg(column)


def distinct_estimate(column: str | Column) -> Column:
    return F.hll_sketch_estimate(column)


def frequency_sketch(column: str, error: float = 0.001, confidence: float = 0.99) -> Column:
    """A Count-Min sketch."""
    return F.count_min_sketch(F.col(column), F.lit(error), F.lit(confidence), F.lit(42))


def quantile_sketch(column: str) -> Column:
    """A KLL sketch of doubles; read with ``kll_sketch_get_quantile_double``."""
    return F.expr(f"kll_sketch_agg_double(CAST({column} AS DOUBLE))")


def bitmap_count(df: DataFrame, column: str) -> DataFrame:
    """The exact number of distinct non-negative integers, by bitmaps of 32768 values each."""
    maps = df.where(F.col(column).isNotNull()).groupBy(F.bitmap_bucket_number(column).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("m"))
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("m")), F.lit(0)).alias("n"))
