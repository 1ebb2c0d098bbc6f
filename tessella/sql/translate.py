"""Translation of the dialect to Spark SQL: a small precedence parser that rewrites expressions where they stand.

It leaves clauses as they are and rewrites what the two dialects read differently: integer and float
division, remainders, arithmetic on booleans and dates, float literals, function names, casts, LIKE's
backslash, null order, window frames, quoted names and generate_series in FROM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tessella.errors import ParseError
from tessella.functions.library import cast_to, expand, float_div, floor_mod, int_div
from tessella.types import INTEGRAL, SQL_TYPES

TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|\|\||[-+*/%<>=(),.;\[\]]))")
#: Words that end an operand.
KEYWORDS = set("""SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT WITH RECURSIVE AS ON USING JOIN INNER LEFT RIGHT FULL OUTER
CROSS NATURAL AND OR NOT IN IS LIKE BETWEEN CASE WHEN THEN ELSE END ASC DESC NULLS FIRST LAST OVER PARTITION ROWS RANGE PRECEDING FOLLOWING UNBOUNDED CURRENT ROW
EXISTS CAST VALUES SET SEMI ANTI FILTER ROLLUP CUBE GROUPING SETS LATERAL""".split())
FROM_ENDS = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "SELECT", "ON", "SET"}
#: Words after which a FROM clause is over.
CLAUSES = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT"}
RECURSION_LIMIT = 1000
BARE_CALLS = {"CURRENT_DATE", "CURRENT_TIMESTAMP", "NOW"}
RETURNS = dict.fromkeys("COUNT CEIL CEILING FLOOR TRUNC TRUNCATE COUNT_DISTINCT ROW_NUMBER RANK DENSE_RANK NTILE".split(), "bigint") | dict.fromkeys("LENGTH POSITION YEAR MONTH DAY HOUR MINUTE SECOND QUARTER DAY_OF_WEEK DAY_OF_YEAR WEEK_OF_YEAR SIGN ASCII DATE_DIFF ARRAY_LENGTH ARRAY_POSITION BIT_COUNT EXTRACT".split(), "int")
RETURNS |= dict.fromkeys("AVG SQRT CBRT POWER EXP LN LOG LOG2 LOG10 RANDOM MEDIAN STDDEV STDDEV_POP VARIANCE VAR_POP PERCENTILE_CONT COSINE_SIMILARITY JACCARD_SIMILARITY".split(), "double") | dict.fromkeys("UPPER LOWER TRIM CONCAT SUBSTR REPLACE".split(), "string")
RETURNS |= dict.fromkeys("TO_DATE DATE_ADD DATE_SUB CURRENT_DATE".split(), "date") | dict.fromkeys("TO_TIMESTAMP NOW CURRENT_TIMESTAMP".split(), "timestamp_ntz")
SAME_TYPE = {"SUM", "MIN", "MAX", "ABS", "MOD", "COALESCE", "NULLIF", "GREATEST", "LEAST", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"}
FRAMED = {"FIRST_VALUE", "LAST_VALUE", "NTH_VALUE", "SUM", "AVG", "COUNT", "MIN", "MAX", "MEDIAN", "STDDEV", "STDDEV_POP", "VARIANCE", "VAR_POP", "PERCENTILE_CONT", "PERCENTILE_DISC", "APPROX_PERCENTILE"}
POWERS = {"OR": 1, "AND": 2, "=": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "IS": 4, "IN": 4, "LIKE": 4, "BETWEEN": 4, "NOT": 4, "||": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7}


class Typed:
    """Spark SQL text and its type's name, which may be found only when asked for; None if it isn't known."""

    def __init__(self, text: str, kind: str | Callable[[], str | None] | None = None) -> None:
        self.text, self._kind = text, kind

    @property
    def kind(self) -> str | None:
        if callable(self._kind):
            self._kind = self._kind()
        return self._kind


def strip_comments(sql: str) -> str:
    """Without ``--`` and nested ``/* */`` comments."""
    out, at, depth = [], 0, 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*|\*/", sql):
        if not depth:
            out.append(sql[at : m.start()])
        at = m.end()
        if m[0] == "/*":
            depth += 1
        elif m[0] == "*/":
            if not depth:
                raise ParseError("a comment ends that didn't begin")
            depth -= 1
        elif not depth and not m[0].startswith("--"):
            out.append(m[0])
        out.append(" ")
    if depth:
        raise ParseError("a comment doesn't end")
    return "".join(out) + sql[at:]


def tokenize(sql: str) -> list[tuple[str, str]]:
    sql, out, at = strip_comments(sql).strip(), [], 0
    while at < len(sql):
        if (m := TOKEN.match(sql, at)) is None or m.end() == at:
            raise ParseError(f"can't read {sql[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
        while at < len(sql) and sql[at].isspace():
            at += 1
    while out and out[-1][1] == ";":
        out.pop()
    return out


class Translator:
    """Rewrites one statement.

    ``expression_type(expression, ctes, from_text)`` gives the Spark type name of translated text over a FROM clause, or None.
    A column is looked up in the FROM clause of its own query, then in those around it.
    """

    def __init__(self, sql: str, expression_type: Callable[[str, str, str], str | None] = lambda *_: None, from_text: str = "") -> None:
        self.tokens, self.at, self.expression_type, self.in_from = tokenize(sql), 0, expression_type, False
        self.scopes, self.ctes, self.derived = [from_text] if from_text else [], [], {}

    def type_of(self, text: str) -> Callable[[], str | None]:
        """The type of translated text in the scopes that are open now, innermost first; found when called."""
        scopes, ctes = tuple(self.scopes), ", ".join(self.ctes)

        def find() -> str | None:
            return next((kind for scope in reversed(scopes) if (kind := self.expression_type(text, ctes, scope)) is not None), None)

        return find

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def word(self, k: int = 0) -> str:
        return self.peek(k).upper() if self.at + k < len(self.tokens) and self.tokens[self.at + k][0] == "word" else ""

    def take(self, wanted: str = "") -> str:
        if self.at >= len(self.tokens):
            raise ParseError(f"the statement ends where {wanted or 'more'} is expected")
        got = self.peek()
        if wanted and got.upper() != wanted:
            raise ParseError(f"{wanted} is expected, not {got!r}")
        self.at += 1
        return got

    def statement(self) -> str:
        out = self.sequence()
        if self.at < len(self.tokens):
            raise ParseError(f"{self.peek()!r} isn't expected")
        return out

    def sequence(self, ends: frozenset[str] | set[str] = frozenset()) -> str:
        """Clauses up to a closing parenthesis, one of the words ``ends``, or the end."""
        out: list[str] = []
        outer, self.in_from = self.in_from, False
        depth, known = len(self.scopes), len(self.ctes)
        while self.at < len(self.tokens) and self.peek() != ")" and self.word() not in ends:
            kind, text = self.tokens[self.at]
            word = self.word()
            if word == "WITH":
                out.append(self.with_clause())
            elif word == "ORDER" and self.word(1) == "BY":
                self.at += 2
                out.append("ORDER BY " + self.order_items())
                self.in_from = False
            elif word in KEYWORDS and not (word in ("CASE", "CAST", "NOT", "EXISTS") or word in ("LEFT", "RIGHT", "GROUPING") and self.peek(1) == "("):
                self.in_from = True if word in ("FROM", "JOIN") else self.in_from and word not in FROM_ENDS
                out.append(text.upper())
                self.at += 1
                if word == "SELECT":
                    del self.scopes[depth:]
                    self.scopes.append(self.from_ahead())
            elif kind == "op" and text not in ("(", "-", "+"):
                out.append(text)
                self.at += 1
            else:
                out.append(self.expr().text)
        del self.scopes[depth:], self.ctes[known:]
        self.in_from = outer
        return " ".join(out)

    def from_ahead(self) -> str:
        """The FROM clause of the SELECT that has just been read, translated; '' if it has none."""
        start, level, at = self.at, 0, self.at
        while at < len(self.tokens):
            text = self.tokens[at][1]
            word = text.upper() if self.tokens[at][0] == "word" else ""
            level += (text == "(") - (text == ")")
            if level < 0 or (not level and word in CLAUSES):
                return ""
            if not level and word == "FROM":
                break
            at += 1
        else:
            return ""
        self.at = at
        try:
            return self.sequence(CLAUSES)
        finally:
            self.at = start

    def with_clause(self) -> str:
        """WITH and its tables; those that name themselves may recurse ``RECURSION_LIMIT`` times."""
        self.take("WITH")
        recursive = self.word() == "RECURSIVE"
        self.at += recursive
        made = []
        while True:
            name = head = identifier(*self.tokens[self.at])
            self.at += 1
            if self.peek() == "(":
                self.take("(")
                columns = []
                while self.peek() != ")":
                    if self.peek() != ",":
                        columns.append(identifier(*self.tokens[self.at]))
                    self.at += 1
                self.take(")")
                head += f" ({', '.join(columns)})"
            if self.word() == "AS":
                self.at += 1
            self.take("(")
            start, limit = self.at, ""
            if recursive and self.names_itself(name):
                limit = f" MAX RECURSION LEVEL {RECURSION_LIMIT}"
                self.ctes.append(f"{head} AS ({self.sequence({'UNION'})})")
                self.at = start
            body = self.sequence()
            self.take(")")
            if not limit:
                self.ctes.append(f"{head} AS ({body})")
            made.append(f"{head}{limit} AS ({body})")
            if self.peek() != ",":
                return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(made)}"
            self.at += 1

    def names_itself(self, name: str) -> bool:
        """Whether the parenthesis that has just been opened holds ``name``."""
        level = 1
        for kind, text in self.tokens[self.at :]:
            level += (text == "(") - (text == ")")
            if not level:
                return False
            if kind in ("word", "quoted") and identifier(kind, text) == name:
                return True
        return False

    def order_items(self) -> str:
        items = []
        while True:
            text = self.expr().text
            way = self.take().upper() if self.word() in ("ASC", "DESC") else "ASC"
            nulls = "LAST" if way == "ASC" else "FIRST"
            if self.word() == "NULLS":
                self.at += 1
                nulls = self.take().upper()
            items.append(f"{text} {way} NULLS {nulls}")
            if self.peek() != ",":
                return ", ".join(items)
            self.at += 1

    def expr(self, least: int = 0) -> Typed:
        left = self.prefix()
        while True:
            op = self.word() or self.peek()
            power = POWERS.get(op)
            if power is None or power < least or (op == "NOT" and self.word(1) not in ("IN", "LIKE", "BETWEEN")):
                return left
            if op == "*" and (self.peek(1) in (",", ")", "") or self.word(1) == "FROM"):
                return left
            left = self.infix(left, op, power)

    def infix(self, a: Typed, op: str, power: int) -> Typed:
        self.at += 1
        if op in ("OR", "AND"):
            b = self.expr(power + 1)
            return Typed(f"({truth(a)} {op} {truth(b)})", "boolean")
        if op == "NOT":
            return Typed(f"(NOT {self.infix(a, self.word(), 4).text})", "boolean")
        if op == "IS":
            negated = self.word() == "NOT"
            self.at += negated
            what = self.take().upper()
            return Typed(f"({a.text} IS {'NOT ' if negated else ''}{what})", "boolean")
        if op == "IN":
            self.take("(")
            if self.word() in ("SELECT", "WITH"):
                inside = self.sequence()
            else:
                inside = ", ".join(self.items())
            self.take(")")
            return Typed(f"({a.text} IN ({inside}))", "boolean")
        if op == "BETWEEN":
            low = self.expr(5)
            self.take("AND")
            return Typed(f"({a.text} BETWEEN {low.text} AND {self.expr(5).text})", "boolean")
        if op == "LIKE":
            return Typed(f"({a.text} LIKE {self.expr(5).text} ESCAPE '\x01')", "boolean")
        b = self.expr(power + 1)
        if power == 4:
            return Typed(f"({a.text} {op} {b.text})", "boolean")
        if op == "||":
            return Typed(f"(CAST({a.text} AS STRING) || CAST({b.text} AS STRING))", "string")
        return arithmetic(op, a, b)

    def prefix(self) -> Typed:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        word = self.word()
        if word == "NOT":
            self.at += 1
            return Typed(f"(NOT {truth(self.expr(3))})", "boolean")
        if text in ("-", "+") and kind == "op":
            self.at += 1
            inner = self.expr(8)
            return Typed(f"({text}{inner.text})" if text == "-" else inner.text, lambda: inner.kind)
        if kind == "number":
            self.at += 1
            if re.fullmatch(r"\d+", text):
                return Typed(text, "int") if int(text) < 2**31 else Typed(f"{text}L", "bigint")
            return Typed(f"{text}D", "double")
        if kind == "string":
            self.at += 1
            return Typed("'" + text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'", "string")
        if text == "(":
            self.at += 1
            start = self.at
            if self.in_from and start in self.derived:
                out, self.at = self.derived[start]
            elif self.in_from:
                out = Typed(f"({self.sequence()})")
                self.derived[start] = out, self.at
            elif self.word() in ("SELECT", "WITH", "VALUES"):
                text = f"({self.sequence()})"
                out = Typed(text, self.type_of(text))
            else:
                parts = [self.expr()]
                while self.peek() == ",":
                    self.at += 1
                    parts.append(self.expr())
                out = Typed("(" + ", ".join(p.text for p in parts) + ")", (lambda: parts[0].kind) if len(parts) == 1 else None)
            self.take(")")
            return out
        if word == "CASE":
            return self.case()
        if word == "CAST":
            self.at += 1
            self.take("(")
            inner = self.expr()
            self.take("AS")
            name = self.take().upper()
            if name not in SQL_TYPES:
                raise ParseError(f"{name} is no type")
            if self.peek() == "(":
                while self.take() != ")":
                    pass
            self.take(")")
            return Typed(cast_to(inner.text, SQL_TYPES[name]), SQL_TYPES[name])
        if word == "EXISTS":
            self.at += 1
            self.take("(")
            inside = self.sequence()
            self.take(")")
            return Typed(f"EXISTS ({inside})", "boolean")
        if word in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return Typed(word, "boolean" if word != "NULL" else None)
        if kind in ("word", "quoted"):
            return self.name()
        raise ParseError(f"{text or 'the end'!r} isn't expected")

    def case(self) -> Typed:
        self.take("CASE")
        out, values, simple = ["CASE"], [], self.word() != "WHEN"
        if simple:
            out.append(self.expr().text)
        while self.word() in ("WHEN", "ELSE"):
            step = self.take().upper()
            value = self.expr()
            if step == "WHEN":
                self.take("THEN")
                then = self.expr()
                values.append(then)
                out.append(f"WHEN {value.text if simple else truth(value)} THEN {then.text}")
            else:
                values.append(value)
                out.append(f"ELSE {value.text}")
        self.take("END")
        return Typed("(" + " ".join(out) + " END)", lambda: next((v.kind for v in values if v.kind), None))

    def items(self) -> list[str]:
        out = []
        while self.peek() != ")":
            out.append(self.expr().text)
            if self.peek() == ",":
                self.at += 1
        return out

    def name(self) -> Typed:
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "word" and self.peek() == "(":
            return self.function(text)
        if kind == "word" and text.upper() in BARE_CALLS:
            return Typed(f"{text}()", RETURNS[text.upper()])
        path = [identifier(kind, text)]
        while self.peek() == ".":
            self.at += 1
            if self.peek() == "*":
                self.at += 1
                return Typed(".".join(path) + ".*")
            path.append(identifier(*self.tokens[self.at]))
            self.at += 1
        return Typed(".".join(path), self.type_of(".".join(path)))

    def function(self, name: str) -> Typed:
        upper = name.upper()
        self.take("(")
        distinct = self.word() == "DISTINCT"
        self.at += distinct
        args: list[Typed] = []
        if self.peek() == "*":
            self.at += 1
            args = [Typed("*")]
        in_from, self.in_from = self.in_from, False
        while self.peek() != ")":
            args.append(self.expr())
            if self.peek() == ",":
                self.at += 1
        self.in_from = in_from
        self.take(")")
        texts = [a.text for a in args]
        if in_from and upper in ("GENERATE_SERIES", "EXPLODE", "UNNEST", "POSEXPLODE"):
            return self.table_function(upper, texts)
        kind = RETURNS.get(upper)
        if kind is None and upper in SAME_TYPE and args:
            kind = lambda: "bigint" if upper == "SUM" and args[0].kind in INTEGRAL else args[0].kind
        if upper == "TRY_CAST":
            wanted = SQL_TYPES[texts[1].strip("'").upper()]
            return Typed(cast_to(texts[0], wanted), wanted)
        if upper == "DATE_TRUNC" and len(args) > 1:
            whole = args[1].kind == "date"
            return Typed(f"CAST({expand(name, texts)} AS DATE)" if whole else expand(name, texts), "date" if whole else "timestamp_ntz")
        if upper == "IF":
            return Typed(f"if(coalesce({truth(args[0])}, false), {texts[1]}, {texts[2]})", lambda: args[1].kind)
        if upper == "GROUPING" and any(w[1].upper() in ("ROLLUP", "CUBE", "SETS") for w in self.tokens):
            return Typed(f"grouping({texts[0]})", "int")
        made = f"{name}(DISTINCT {', '.join(texts)})" if distinct else "count(*)" if upper == "COUNT" and texts == ["*"] else expand(name, texts)
        if self.word() == "FILTER":
            self.at += 1
            self.take("(")
            self.take("WHERE")
            made += f" FILTER (WHERE {self.expr().text})"
            self.take(")")
        if self.word() == "OVER":
            return Typed(self.over(upper, texts, made), kind)
        return Typed(made, kind)

    def table_function(self, name: str, args: list[str]) -> Typed:
        alias = "generate_series" if name == "GENERATE_SERIES" else "col"
        if self.word() == "AS":
            self.at += 1
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "quoted") and self.word() not in KEYWORDS:
            alias = identifier(*self.tokens[self.at])
            self.at += 1
        if name == "POSEXPLODE":
            return Typed(f"(SELECT posexplode({args[0]}) AS (pos, {alias})) AS {alias}")
        if name == "GENERATE_SERIES":
            start, stop = (f"CAST({x} AS BIGINT)" for x in args[:2])
            step = f"CAST({args[2]} AS BIGINT)" if len(args) > 2 else "1L"
            # An empty series where the step leads away; a zero step counts as one.
            step = f"coalesce(nullif({step}, 0L), 1L)"
            body = f"CASE WHEN ({stop} - {start}) * sign({step}) < 0 THEN array() ELSE sequence({start}, {stop}, {step}) END"
            return Typed(f"(SELECT explode({body}) AS {alias}) AS {alias}")
        return Typed(f"(SELECT explode({args[0]}) AS {alias}) AS {alias}")

    def over(self, name: str, args: list[str], made: str) -> str:
        self.take("OVER")
        self.take("(")
        parts, order, frame = "", "", ""
        if self.word() == "PARTITION":
            self.at += 2
            keys = [self.expr().text]
            while self.peek() == ",":
                self.at += 1
                keys.append(self.expr().text)
            parts = "PARTITION BY " + ", ".join(keys)
        if self.word() == "ORDER":
            self.at += 2
            order = "ORDER BY " + self.order_items()
        if self.word() in ("ROWS", "RANGE"):
            frame = self.take().upper() + " "
            words = []
            while self.peek() != ")":
                words.append(self.take().upper())
            text = " ".join(words)
            frame += text if text.startswith("BETWEEN") else f"BETWEEN {text} AND CURRENT ROW"
        self.take(")")
        if not frame and order and name in FRAMED:
            frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        window = " ".join(x for x in (parts, order, frame) if x)
        if name in ("MEDIAN", "PERCENTILE_CONT", "APPROX_PERCENTILE") and order:
            # Spark has no ordered-frame percentile: sort what the frame holds and take what lies at the fraction.
            rows = f"array_sort(collect_list(CAST({args[0]} AS DOUBLE)) OVER ({window}))"
            return sliding_percentile(rows, args[1] if len(args) > 1 and name != "MEDIAN" else "0.5D")
        return f"{made} OVER ({window})"


def sliding_percentile(rows: str, fraction: str) -> str:
    """What lies at a fraction of a sorted array, between two values in proportion; null for an empty one."""
    place = f"(size({rows}) - 1) * CAST({fraction} AS DOUBLE)"
    low, high = f"get({rows}, CAST(floor({place}) AS INT))", f"get({rows}, CAST(ceil({place}) AS INT))"
    return f"({low} + ({high} - {low}) * ({place} - floor({place})))"


def identifier(kind: str, text: str) -> str:
    return "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`" if kind == "quoted" else text.lower()


def truth(a: Typed) -> str:
    """A condition; numbers count as true unless zero."""
    return f"({a.text} != 0)" if a.kind in INTEGRAL or a.kind == "double" else a.text


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = (Typed(f"CAST({x.text} AS INT)", "int") if x.kind == "boolean" else x for x in (a, b))
    whole = a.kind in INTEGRAL and b.kind in INTEGRAL
    if op == "/":
        kind = "bigint" if "bigint" in (a.kind, b.kind) else "int"
        return Typed(int_div(a.text, b.text, kind == "int"), kind) if whole else Typed(float_div(a.text, b.text), "double")
    if op == "%":
        return Typed(floor_mod(a.text, b.text), a.kind if whole else "double")
    if a.kind == "date" and b.kind in INTEGRAL:
        return Typed(f"date_{'add' if op == '+' else 'sub'}({a.text}, CAST({b.text} AS INT))", "date")
    if a.kind == b.kind == "date" and op == "-":
        return Typed(f"datediff({a.text}, {b.text})", "int")
    if (a.kind or "").startswith("timestamp") and b.kind in INTEGRAL:
        return Typed(f"CAST(timestamp_micros(unix_micros(CAST({a.text} AS TIMESTAMP)) {op} {b.text}) AS TIMESTAMP_NTZ)", "timestamp_ntz")
    if (a.kind or "").startswith("timestamp") and (b.kind or "").startswith("timestamp") and op == "-":
        return Typed(f"(unix_micros(CAST({a.text} AS TIMESTAMP)) - unix_micros(CAST({b.text} AS TIMESTAMP)))", "bigint")
    kind = "double" if "double" in (a.kind, b.kind) else ("bigint" if "bigint" in (a.kind, b.kind) else "int") if whole else None
    return Typed(f"({a.text} {op} {b.text})", kind)


def translate(sql: str, expression_type: Callable[[str, str, str], str | None] = lambda *_: None) -> str:
    """A query of the dialect as Spark SQL."""
    return Translator(sql, expression_type).statement()
