"""tessella: a Spark-first OLAP SQL engine and function library."""

from __future__ import annotations

from tessella.session import get_spark

__all__ = ["get_spark"]
__version__ = "0.1.0"
