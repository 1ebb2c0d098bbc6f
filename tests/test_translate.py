"""The dialect translator, without Spark."""

from __future__ import annotations

import pytest

from tessella.errors import ParseError
from tessella.sql.translate import strip_comments, translate

KINDS = {"a": "int", "b": "bigint", "d": "double", "s": "string", "dt": "date", "ts": "timestamp_ntz"}


def kind_of(expression: str, ctes: str, from_text: str) -> str | None:
    return KINDS.get(expression) if from_text else None


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT a / 2 FROM t", "SELECT CAST((a) div (2) AS INT) FROM t"),
        ("SELECT b / a FROM t", "SELECT ((b) div (a)) FROM t"),
        ("SELECT 1.5", "SELECT 1.5D"),
        ("SELECT 3000000000", "SELECT 3000000000L"),
        ("SELECT TRUE + 1", "SELECT (CAST(TRUE AS INT) + 1)"),
        ("SELECT dt - dt FROM t", "SELECT datediff(dt, dt) FROM t"),
        ("SELECT 'it''s'", r"SELECT 'it\'s'"),
        ('SELECT "Odd Name" FROM T', "SELECT `Odd Name` FROM t"),
        ("SELECT a FROM t ORDER BY a DESC", "SELECT a FROM t ORDER BY a DESC NULLS FIRST"),
        ("SELECT a NOT IN (1, 2) FROM t", "SELECT (NOT (a IN (1, 2))) FROM t"),
        ("SELECT left(s, 2) FROM t LEFT JOIN u ON t.a = u.a", "SELECT left(s, 2) FROM t LEFT JOIN u ON (t.a = u.a)"),
        ("SELECT count(*) * 2 FROM t", "SELECT (count(*) * 2) FROM t"),
        ("SELECT a FROM t WHERE s", "SELECT a FROM t WHERE s"),
        ("SELECT a FROM t WHERE a", "SELECT a FROM t WHERE a"),
        ("WITH RECURSIVE c (n) AS (SELECT 1 UNION ALL SELECT n FROM c) SELECT n FROM c", "WITH RECURSIVE c (n) MAX RECURSION LEVEL 1000 AS (SELECT 1 UNION ALL SELECT n FROM c) SELECT n FROM c"),
        ("SELECT date_trunc('MONTH', dt) FROM t", "SELECT CAST(CAST(date_trunc('MONTH', dt) AS TIMESTAMP_NTZ) AS DATE) FROM t"),
        ("SELECT sum(a) OVER (ORDER BY b) FROM t", "SELECT sum(a) OVER (ORDER BY b ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t"),
        ("SELECT max(a) OVER (PARTITION BY s ORDER BY b ROWS 2 PRECEDING) FROM t", "SELECT max(a) OVER (PARTITION BY s ORDER BY b ASC NULLS LAST ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) FROM t"),
    ],
)
def test_translation(sql: str, expected: str) -> None:
    assert " ".join(translate(sql, kind_of).replace(" , ", ", ").split()) == expected


@pytest.mark.parametrize("sql", ["SELECT (1", "SELECT 'x", "SELECT 1)", "SELECT CAST(1 AS NOTYPE)", "/* open"])
def test_refused(sql: str) -> None:
    with pytest.raises(ParseError):
        translate(sql)


def test_comments() -> None:
    assert strip_comments("a /* x /* y */ z */ b -- c\nd '--' ").split() == ["a", "b", "d", "'--'"]
