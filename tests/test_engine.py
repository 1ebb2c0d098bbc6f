"""Statements and queries through the engine, on tables with rows that are written out here."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import SparkSession

from tessella.engine import Engine
from tessella.errors import DuplicateError, EngineError, ExecutionError, ParseError, SemanticError


@pytest.fixture
def engine(spark: SparkSession) -> Engine:
    e = Engine(spark)
    e.register("users", spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35), (4, "Diana", 28), (5, "Eve", 30)], "id int, name string, age int"))
    e.register("dept", spark.createDataFrame([(1, "Engineering"), (2, "Sales")], "id int, name string"))
    e.register("emp", spark.createDataFrame([(1, "Alice", 1, 80000), (2, "Bob", 2, 60000), (3, "Charlie", 1, 90000), (4, "Diana", 2, 70000), (5, "Eve", 1, 85000)], "id int, name string, dept_id int, salary int"))
    e.register("ntest", spark.createDataFrame([(1, 10, "x", True), (2, None, "y", False), (3, 30, None, None), (4, None, None, True), (5, 50, "z", False)], "id int, a int, b string, c boolean"))
    return e


def rows(engine: Engine, sql: str) -> list[list]:
    return engine.execute(sql).rows()


def one(engine: Engine, expr: str) -> object:
    return rows(engine, f"SELECT {expr} AS v")[0][0]


@pytest.mark.parametrize(
    ("expr", "value"),
    [
        ("-7 / 2", -3), ("7 % -3", -2), ("-7 % 3", 2), ("TRUE + 1", 2), ("1.0 / 0", math.inf), ("-1.0 / 0", -math.inf), ("MOD(5, 0)", None), ("ROUND(2.5)", 2), ("ROUND(3.5)", 4), ("TRUNC(-2.7)", -2),
        ("CONCAT('a', NULL, 'b')", "ab"), ("'a' || NULL", None), ("LPAD('abc', 2, '*')", "abc"), ("LPAD('a', 3, '*-')", "**a"), ("SUBSTR('hello', 2, 3)", "ell"), ("SUBSTR('hello', 0, 2)", "he"), ("TRIM('\t a \n')", "a"),
        ("INITCAP('o''neil x')", "O'Neil X"), ("CHR(8364)", "€"), ("POSITION('l', 'hello')", 3), ("SPLIT_PART('a,b', ',', 3)", ""), ("REGEXP_REPLACE('ab', '(a)(b)', '\\2\\1')", "ba"), ("CAST('x' AS INT)", None), ("CAST('yes' AS BOOLEAN)", True),
        ("GREATEST(1, NULL, 3)", 3), ("BIT_COUNT(-7)", 3), ("WIDTH_BUCKET(5, 0, 10, 5)", 3), ("TYPEOF(1)", "INT"), ("TYPEOF(NULL)", "NULL"), ("IF(NULL, 1, 2)", 2), ("NULLIF(1, 1)", None), ("ARRAY_SLICE(ARRAY(1, 2, 3, 4), 2, 3)", [2, 3]),
        ("ARRAY_INTERSECT(ARRAY(1, 1, 2), ARRAY(1))", [1, 1]), ("ARRAY_POSITION(ARRAY(1), 9)", 0), ("COSINE_SIMILARITY(ARRAY(1, 0), ARRAY(0, 1))", 0.0), ("JACCARD_SIMILARITY(ARRAY(1, 2), ARRAY(2, 3))", 1 / 3), ("SIMHASH_SIMILARITY('a b', 'A  b')", 1.0),
        ("DAY_OF_WEEK(TO_DATE('2024-03-17'))", 7), ("DATE_DIFF(TO_DATE('2024-03-01'), TO_DATE('2024-02-01'))", 29), ("TO_DATE('01/15/2024') = TO_DATE('15.01.2024')", True), ("'100%' LIKE '100%'", True), ("'a\\b' LIKE 'a\\b'", True), ("NULL IN (1)", None), ("1 NOT IN (2, NULL)", None),
        ("NULL AND FALSE", False), ("NULL OR TRUE", True), ("NOT NULL", None), ("2 BETWEEN 1 AND 2", True), ("CASE 1 WHEN 2 THEN 'x' END", None),
    ],
)
def test_scalar(engine: Engine, expr: str, value: object) -> None:
    got = one(engine, expr)
    assert got == value or (isinstance(value, float) and got == pytest.approx(value))


def test_division_by_zero(engine: Engine) -> None:
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(engine, "1 / (id - id) AS v FROM users --")


def test_create_errors(engine: Engine) -> None:
    engine.execute("CREATE TABLE t (a INT NOT NULL, b VARCHAR(2))")
    assert engine.execute("CREATE TABLE IF NOT EXISTS t (a INT)").message == "Table exists"
    with pytest.raises(DuplicateError):
        engine.execute("CREATE TABLE t (a INT)")
    with pytest.raises(SemanticError):
        engine.execute("CREATE TABLE u (a INT, a INT)")
    with pytest.raises(SemanticError):
        engine.execute("DROP TABLE nothing")
    with pytest.raises(ParseError):
        engine.execute("FROBNICATE t")
    with pytest.raises(EngineError):
        engine.execute("SELECT * FROM nothing")


def test_dml(engine: Engine) -> None:
    engine.execute("CREATE TABLE t (a INT NOT NULL, b VARCHAR(2), c DOUBLE)")
    assert engine.execute("INSERT INTO t VALUES (1, 'abc', 1.5), (2, NULL, NULL)").affected_rows == 2
    with pytest.raises(ExecutionError):
        engine.execute("INSERT INTO t (b) VALUES ('x')")
    with pytest.raises(SemanticError):
        engine.execute("INSERT INTO t (a, b) VALUES (1)")
    assert engine.execute("UPDATE t SET a = a + 10, c = a WHERE b IS NULL").affected_rows == 1
    assert sorted(rows(engine, "SELECT a, b, c FROM t")) == [[1, "ab", 1.5], [12, None, 2.0]]
    assert engine.execute("DELETE FROM t WHERE c > 1.8").affected_rows == 1
    assert rows(engine, "SELECT a FROM t") == [[1]]


def test_transaction(engine: Engine) -> None:
    engine.execute("CREATE TABLE t (a INT)")
    engine.execute("INSERT INTO t VALUES (1)")
    engine.execute("BEGIN")
    engine.execute("DELETE FROM t")
    assert rows(engine, "SELECT count(*) AS n FROM t") == [[0]]
    engine.execute("ROLLBACK")
    assert rows(engine, "SELECT count(*) AS n FROM t") == [[1]]
    with pytest.raises(ExecutionError):
        engine.execute("COMMIT")


def test_alter(engine: Engine) -> None:
    engine.execute("CREATE TABLE t (a INT)")
    engine.execute("INSERT INTO t VALUES (1)")
    engine.execute("ALTER TABLE t ADD COLUMN b TEXT")
    engine.execute("ALTER TABLE t RENAME COLUMN a TO z")
    assert engine.execute("SELECT * FROM t").columns == ["z", "b"]
    engine.execute("ALTER TABLE t DROP COLUMN b")
    with pytest.raises(SemanticError):
        engine.execute("ALTER TABLE t DROP COLUMN z")


def test_joins(engine: Engine) -> None:
    assert len(rows(engine, "SELECT e.name FROM emp e JOIN dept d ON e.dept_id = d.id WHERE d.name = 'Sales'")) == 2
    assert rows(engine, "SELECT d.name, (SELECT count(*) FROM emp WHERE dept_id = d.id) AS n FROM dept d ORDER BY d.id") == [["Engineering", 3], ["Sales", 2]]
    assert len(rows(engine, "SELECT a.id FROM users a CROSS JOIN dept")) == 10
    assert rows(engine, "SELECT name FROM dept d WHERE NOT EXISTS (SELECT 1 FROM emp WHERE dept_id = d.id AND salary > 75000)") == [["Sales"]]


def test_nulls(engine: Engine) -> None:
    assert rows(engine, "SELECT count(a) AS n, sum(a) AS s FROM ntest") == [[3, 90]]
    assert [r[0] for r in rows(engine, "SELECT a FROM ntest ORDER BY a")] == [10, 30, 50, None, None]
    assert [r[0] for r in rows(engine, "SELECT a FROM ntest ORDER BY a DESC")] == [None, None, 50, 30, 10]


def test_recursion(engine: Engine) -> None:
    assert [r[0] for r in rows(engine, "WITH RECURSIVE c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c WHERE n < 5) SELECT n FROM c ORDER BY n")] == [1, 2, 3, 4, 5]
    assert [r[0] for r in rows(engine, "WITH RECURSIVE c AS (SELECT 1 AS n UNION SELECT n % 3 + 1 FROM c) SELECT n FROM c ORDER BY n")] == [1, 2, 3]


def test_window_and_series(engine: Engine) -> None:
    assert rows(engine, "SELECT name, sum(salary) OVER (PARTITION BY dept_id ORDER BY id) AS s FROM emp WHERE dept_id = 2 ORDER BY id") == [["Bob", 60000], ["Diana", 130000]]
    assert rows(engine, "SELECT median(salary) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM emp ORDER BY id LIMIT 2") == [[80000.0], [70000.0]]
    assert [r[0] for r in rows(engine, "SELECT * FROM generate_series(5, 1, -2)")] == [5, 3, 1]


def test_copy(engine: Engine, tmp_path: object) -> None:
    (path := tmp_path / "in.csv").write_text('a,b\n1,"x ""q"", y"\nbad,z\n,w\n')
    engine.execute("CREATE TABLE t (a INT, b TEXT)")
    engine.execute(f"COPY t FROM '{path}' WITH (HEADER true)")
    assert sorted(rows(engine, "SELECT b, a FROM t")) == [["w", None], ['x "q", y', 1], ["z", None]]
    engine.execute("CREATE TABLE n (a INT NOT NULL, b TEXT)")
    assert "refused 2" in engine.execute(f"COPY n FROM '{path}'").message
    engine.execute(f"COPY t TO '{tmp_path}/out'")
    assert engine.import_csv(f"{tmp_path}/out", "again").affected_rows == 3


def test_tools(engine: Engine) -> None:
    assert engine.execute("EXPLAIN SELECT * FROM users").columns == ["Plan"]
    stats = {r.column_name: r for r in engine.analyze_table("ntest").collect()}
    assert (stats["a"].row_count, stats["a"].null_count, stats["a"].min, stats["a"].max) == (5, 2, "10", "50")
    assert ["users", False] in rows(engine, "SELECT table_name, is_system FROM sys_tables")
    with pytest.raises(SemanticError):
        engine.execute("DELETE FROM sys_tables")


def test_derived_types_do_not_depend_on_other_tables(spark: SparkSession) -> None:
    engine = Engine(spark)
    engine.execute("CREATE TABLE a1 (k INT, b BOOLEAN)")
    engine.execute("INSERT INTO a1 VALUES (7, TRUE)")
    engine.execute("CREATE TABLE a2 (k DOUBLE)")
    one = lambda sql: engine.execute(sql).rows()[0]
    assert one("SELECT k / 2, b + 1 FROM a1") == [3, 2]
    assert one("SELECT x.k / 2, x.c + 1 FROM (SELECT k, b AS c FROM a1) x") == [3, 2]
    assert one("WITH t AS (SELECT k AS n FROM a1) SELECT n / 2, (SELECT max(n) FROM t) / 2 FROM t") == [3, 3]
    assert one("SELECT (SELECT 7) / 2") == [3]
    assert one("SELECT n / 2 FROM generate_series(7, 7) AS n") == [3]


def test_dropped_and_rolled_back_tables_are_gone(spark: SparkSession) -> None:
    engine, other = Engine(spark), Engine(spark)
    engine.execute("CREATE TABLE gone (k INT)")
    engine.execute("INSERT INTO gone VALUES (1)")
    assert engine.execute("SELECT k FROM gone").rows() == [[1]]
    with pytest.raises(SemanticError):
        other.execute("SELECT k FROM gone")
    engine.execute("DROP TABLE gone")
    with pytest.raises(SemanticError):
        engine.execute("SELECT k FROM gone")
    engine.execute("BEGIN")
    engine.execute("CREATE TABLE later (k INT)")
    engine.execute("SELECT k FROM later")
    engine.execute("ROLLBACK")
    with pytest.raises(SemanticError):
        engine.execute("SELECT k FROM later")


def test_similarities_compute_tokens_outside_their_loops(spark: SparkSession) -> None:
    engine = Engine(spark)
    # k, i and s are also names of the loops' variables: tokens that are split inside a loop would be those of its counter.
    engine.register("t", spark.createDataFrame([(1, "a b c d", "d c b a", "x y"), (2, "p q", "P  q", "p q r"), (3, "", "", "")], "id int, k string, i string, s string"))
    engine.register("u", spark.createDataFrame([(1, "a b c d", "d c b a", "x y"), (2, "p q", "P  q", "p q r"), (3, "", "", "")], "id int, x string, y string, z string"))
    sql = "SELECT id, MINHASH_JACCARD({0}, {1}), MINHASH_JACCARD({0}, {2}), SIMHASH_SIMILARITY({1}, {2}), SIMHASH_SIMILARITY({0}, {1}) FROM {3} ORDER BY id"
    got = rows(engine, sql.format("k", "i", "s", "t"))
    assert got == rows(engine, sql.format("x", "y", "z", "u"))
    assert [r[1] for r in got] == [1.0, 1.0, 1.0]
    assert got[0][2] == 0.0 and 0.3 < got[1][2] < 1.0
