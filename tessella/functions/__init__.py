"""The function library: names of the dialect as Spark SQL expressions.

``call(name, *args)`` gives a Column; arguments are Columns' SQL texts, column names or literals written as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.library import expand

__all__ = ["call", "expand"]


def call(name: str, *args: str | int | float) -> Column:
    return F.expr(expand(name, [str(a) for a in args]))
