"""SQL type names of the dialect and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names of the dialect. FLOAT and DECIMAL are double precision.
SQL_TYPES = {
    "INT": "int", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "DECIMAL": "double",
    "NUMERIC": "double", "BOOLEAN": "boolean", "BOOL": "boolean", "VARCHAR": "string", "TEXT": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}
NAMES = {"int": "INT", "smallint": "INT", "tinyint": "INT", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "void": "NULL"}
INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def sql_name(kind: T.DataType | str) -> str:
    """The dialect's name of a Spark type; arrays and others as Spark writes them, in capitals."""
    text = kind if isinstance(kind, str) else kind.simpleString()
    return NAMES.get(text, text.upper())
