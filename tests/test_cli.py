"""The shell over an engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessella.cli import Shell, split_statements
from tessella.engine import Engine


def test_split() -> None:
    assert list(split_statements("a ';' b; -- c;\n d; ; /* ; */ e")) == ["a ';' b", "-- c;\n d", "/* ; */ e"]


def test_shell(spark: SparkSession) -> None:
    out: list[str] = []
    shell = Shell(Engine(spark), out.append)
    shell.run("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (NULL); SELECT a FROM t ORDER BY a;")
    shell.run(".timer off")
    shell.run(".tables")
    shell.run(".schema t")
    shell.run(".history 1")
    assert [x for x in out if not x.startswith("(")] == ["Table created", "Inserted 2 rows", "a", "1", "NULL", "t", "a int", "SELECT a FROM t ORDER BY a"]
    shell.run(".quit")
    assert shell.done


def test_registered_function(spark: SparkSession) -> None:
    engine = Engine(spark)
    engine.register_function("twice", lambda v: v * 2, "BIGINT")
    assert engine.execute("SELECT twice(a) AS v FROM generate_series(2, 3) AS a ORDER BY v").rows() == [[4], [6]]
