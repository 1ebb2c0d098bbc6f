"""The engine: SQL text of the dialect in, DataFrames out.

Tables are immutable Parquet versions behind a name. DML writes a new version and swaps the name to it when
that has succeeded; a transaction keeps the versions it began with and swaps back on rollback. Queries are
translated and handed to Catalyst whole.
"""

from __future__ import annotations

import re
import statistics
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import DuplicateError, EngineError, ExecutionError, ParseError, SemanticError
from tessella.operators.fixpoint import fixpoint, shared_folder
from tessella.sources.csv import read_csv, write_csv
from tessella.sql.translate import Translator, strip_comments, tokenize, translate
from tessella.types import SQL_TYPES, sql_name

SYSTEM = ("sys_tables", "sys_columns")


@dataclass
class Result:
    """What a statement gives: a DataFrame for queries, a message and a count of rows for others."""

    df: DataFrame | None = None
    message: str = ""
    affected_rows: int = 0

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self) -> list[list]:
        """All rows on the driver; for results that are known to be small."""
        return [list(r) for r in self.df.collect()] if self.df is not None else []


@dataclass
class Table:
    schema: T.StructType
    df: DataFrame
    lengths: dict[str, int] = field(default_factory=dict)


class Engine:
    """One catalogue of tables over a Spark session."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.given = spark, folder
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, tuple[str, tuple[str, ...], bool]] = {}
        self.saved: dict[str, Table] | None = None
        self.stats: dict[str, DataFrame] = {}
        self.types: dict[tuple[str, str, str], str | None] = {}

    @property
    def folder(self) -> str:
        """Where versions of tables are written; made up at the first write if none was given."""
        self.given = self.given or f"{shared_folder(self.spark)}/engine-{uuid.uuid4().hex}"
        return self.given

    # --- catalogue -------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame) -> None:
        """Make an existing DataFrame a table; nothing is copied."""
        self.tables[name.lower()] = Table(df.schema, df)

    def get_table_names(self) -> list[str]:
        return sorted(self.tables)

    def table_exists(self, name: str) -> bool:
        return name.lower() in self.tables

    def get_table_schema(self, name: str) -> T.StructType:
        return self._table(name).schema

    def get_table_row_count(self, name: str) -> int:
        return self._table(name).df.count()

    def create_table_from_schema(self, name: str, schema: T.StructType) -> None:
        if name.lower() in self.tables or name.lower() in SYSTEM:
            raise DuplicateError(f"table {name} exists")
        self.tables[name.lower()] = Table(schema, self.spark.createDataFrame([], schema))

    def _table(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise SemanticError(f"there is no table {name}") from None

    def _system(self, name: str) -> DataFrame:
        if name == SYSTEM[0]:
            return self.spark.createDataFrame([(t, False) for t in sorted(self.tables)] + [(t, True) for t in SYSTEM], "table_name string, is_system boolean")
        rows = [(t, f.name, sql_name(f.dataType), f.nullable, k) for t in sorted(self.tables) for k, f in enumerate(self.tables[t].schema, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean, ordinal_position int")

    def _expression_type(self, expression: str, ctes: str, from_text: str) -> str | None:
        """The type of translated text over a translated FROM clause; None if it can't be told there."""
        key = (expression, ctes, from_text)
        if key not in self.types:
            try:
                found = self._run(f"{f'WITH {ctes} ' if ctes else ''}SELECT {expression} {from_text}").schema
                self.types[key] = found[0].dataType.simpleString() if len(found) == 1 else None
            except (EngineError, PySparkException):
                self.types[key] = None
        return self.types[key]

    def _swap(self, name: str, df: DataFrame) -> None:
        """Write a new version of a table and let the name stand for it."""
        table = self._table(name)
        path = f"{self.folder}/{name.lower()}/{uuid.uuid4().hex}"
        fitted = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema])
        fitted.write.parquet(path)
        self.tables[name.lower()] = Table(table.schema, self.spark.read.schema(table.schema).parquet(path), table.lengths)

    def register_function(self, name: str, function: Callable, return_type: str) -> None:
        """A scalar function over Arrow batches (pandas Series in, a Series out) that SQL can call by name."""
        self.spark.udf.register(name, F.pandas_udf(function, SQL_TYPES.get(return_type.upper(), return_type)))

    # --- statements ------------------------------------------------------------------------------------------

    def execute(self, sql: str) -> Result:
        """Run one statement."""
        words = tokenize(sql)
        if not words:
            raise ParseError("the statement is empty")
        first = words[0][1].upper()
        handler = getattr(self, f"_do_{first.lower()}", None)
        if handler is not None:
            return handler(strip_comments(sql).strip().rstrip(";").strip())
        if first in ("SELECT", "WITH", "VALUES") or words[0][1] == "(":
            return Result(self.query(sql))
        raise ParseError(f"{first} begins no statement")

    def query(self, sql: str) -> DataFrame:
        """The DataFrame of a query."""
        if (found := self._recursive_union(sql)) is not None:
            return found
        self.types.clear()
        return self._run(translate(sql, self._expression_type))

    def _run(self, spark_sql: str) -> DataFrame:
        # Views live for the analysis only: what is dropped, rolled back or another engine's isn't found later.
        words = {m.lower() for m in re.findall(r"[A-Za-z_]\w*", spark_sql)}
        views = {n: self.tables[n].df for n in words & set(self.tables)} | {n: self._system(n) for n in words & set(SYSTEM)}
        try:
            for name, df in views.items():
                df.createOrReplaceTempView(name)
            return self.spark.sql(spark_sql)
        except AnalysisException as e:
            raise SemanticError(str(e).split("\n")[0]) from e
        except Exception as e:
            if type(e).__name__ == "ParseException":
                raise ParseError(str(e).split("\n")[0]) from e
            raise
        finally:
            for name in views:
                self.spark.catalog.dropTempView(name)

    def _recursive_union(self, sql: str) -> DataFrame | None:
        """``WITH RECURSIVE x AS (base UNION step) query``: Spark recurses over UNION ALL only."""
        words = tokenize(sql)
        if [w[1].upper() for w in words[:2]] != ["WITH", "RECURSIVE"]:
            return None
        at, names = 3, []
        name = words[2][1].lower()
        if words[at][1] == "(":
            close = next(k for k in range(at, len(words)) if words[k][1] == ")")
            names, at = [w[1].lower() for w in words[at + 1 : close] if w[1] != ","], close + 1
        at += words[at][1].upper() == "AS"
        depth, split, end = 0, None, None
        for k in range(at, len(words)):
            depth += (words[k][1] == "(") - (words[k][1] == ")")
            if depth == 1 and words[k][1].upper() == "UNION" and split is None:
                split = k
            if depth == 0:
                end = k
                break
        if split is None or end is None or words[split + 1][1].upper() == "ALL" or end + 1 >= len(words) or words[end + 1][1] == ",":
            return None
        text = lambda part: " ".join(w[1] for w in part)
        base = self.query(text(words[at + 1 : split]))
        base = base.toDF(*names) if names else base
        step = text(words[split + 1 : end])

        def grow(new: DataFrame) -> DataFrame:
            inner = Engine(self.spark, self.given)
            inner.tables = self.tables | {name: Table(new.schema, new)}
            return inner.query(step)

        inner = Engine(self.spark, self.given)
        whole = fixpoint(base, grow)
        inner.tables = self.tables | {name: Table(whole.schema, whole)}
        return inner.query(text(words[end + 1 :]))

    def _match(self, pattern: str, sql: str) -> re.Match:
        if (m := re.fullmatch(pattern, sql, re.I | re.S)) is None:
            raise ParseError(f"can't read {sql[:60]!r}")
        return m

    def _writable(self, name: str) -> Table:
        if name.lower() in SYSTEM:
            raise SemanticError(f"{name} is a system table")
        return self._table(name)

    def _do_create(self, sql: str) -> Result:
        if re.match(r"CREATE\s+(UNIQUE\s+)?INDEX", sql, re.I):
            m = self._match(r"CREATE\s+(UNIQUE\s+)?INDEX\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+ON\s+(\w+)\s*\(([^)]*)\)", sql)
            if m[3].lower() in self.indexes:
                if m[2]:
                    return Result(message="Index exists")
                raise DuplicateError(f"index {m[3]} exists")
            columns = tuple(c.strip().lower() for c in m[5].split(","))
            if missing := set(columns) - {f.name.lower() for f in self._writable(m[4]).schema}:
                raise SemanticError(f"{m[4]} has no column {missing.pop()}")
            # Row groups' statistics serve look-ups; an index only records what they should be on.
            self.indexes[m[3].lower()] = (m[4].lower(), columns, bool(m[1]))
            return Result(message="Index created")
        m = self._match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+|\"[^\"]+\")\s*\((.*)\)", sql)
        name = m[2].strip('"').lower()
        if name in self.tables and m[1]:
            return Result(message="Table exists")
        fields, lengths = [], {}
        for part in re.split(r",(?![^(]*\))", m[3]):
            c = self._match(r"\s*(\w+|\"[^\"]+\")\s+(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*\d+\s*)?\))?((?:\s+(?:NOT\s+NULL|NULL|PRIMARY\s+KEY))*)\s*", part)
            if c[2].upper() not in SQL_TYPES:
                raise ParseError(f"{c[2]} is no type")
            column = c[1][1:-1] if c[1].startswith('"') else c[1].lower()
            if column in {f.name for f in fields}:
                raise SemanticError(f"column {column} occurs twice")
            rest = c[4].upper()
            fields.append(T.StructField(column, T._parse_datatype_string(SQL_TYPES[c[2].upper()]), "NOT NULL" not in re.sub(r"\s+", " ", rest) and "PRIMARY" not in rest))
            if c[3] and c[2].upper() == "VARCHAR":
                lengths[column] = int(c[3])
        self.create_table_from_schema(name, T.StructType(fields))
        self.tables[name].lengths = lengths
        return Result(message="Table created")

    def _do_drop(self, sql: str) -> Result:
        m = self._match(r"DROP\s+(TABLE|INDEX)\s+(IF\s+EXISTS\s+)?(\w+)", sql)
        where = self.tables if m[1].upper() == "TABLE" else self.indexes
        if m[3].lower() not in where:
            if m[2]:
                return Result(message="Nothing to drop")
            raise SemanticError(f"there is no {m[1].lower()} {m[3]}")
        del where[m[3].lower()]
        return Result(message="Dropped")

    def _do_alter(self, sql: str) -> Result:
        m = self._match(r"ALTER\s+TABLE\s+(\w+)\s+(ADD|DROP|RENAME)\s+(?:COLUMN\s+)?(\w+)\s*(.*)", sql)
        name, what, column, rest = m[1].lower(), m[2].upper(), m[3].lower(), m[4].strip()
        table = self._writable(name)
        names = [f.name for f in table.schema]
        if (what == "ADD") == (column in names):
            raise (DuplicateError if what == "ADD" else SemanticError)(f"column {column} {'exists' if what == 'ADD' else 'is missing'} in {name}")
        if what == "ADD":
            kind = re.match(r"\w+", rest)[0].upper() if re.match(r"\w+", rest) else ""
            if kind not in SQL_TYPES:
                raise ParseError(f"{kind} is no type")
            df, fields = table.df.withColumn(column, F.lit(None).cast(SQL_TYPES[kind])), [*table.schema, T.StructField(column, T._parse_datatype_string(SQL_TYPES[kind]))]
        elif what == "DROP":
            if len(names) == 1:
                raise SemanticError("a table keeps at least one column")
            df, fields = table.df.drop(column), [f for f in table.schema if f.name != column]
        else:
            new = self._match(r"TO\s+(\w+)", rest)[1].lower()
            if new in names:
                raise DuplicateError(f"column {new} exists in {name}")
            df, fields = table.df.withColumnRenamed(column, new), [T.StructField(new, f.dataType, f.nullable) if f.name == column else f for f in table.schema]
        self.tables[name] = Table(T.StructType(fields), df, {k: v for k, v in table.lengths.items() if k in {f.name for f in fields}})
        return Result(message="Table altered")

    def _insert(self, name: str, rows: DataFrame, columns: list[str]) -> Result:
        table = self._writable(name)
        if len(set(columns)) != len(columns):
            raise SemanticError("a column is named twice")
        fields = {f.name: f for f in table.schema}
        if missing := [c for c in columns if c not in fields]:
            raise SemanticError(f"{name} has no column {missing[0]}")
        if len(rows.columns) != len(columns):
            raise SemanticError(f"{len(rows.columns)} values for {len(columns)} columns")
        given = dict(zip(columns, rows.toDF(*[f"c{k}" for k in range(len(columns))]).columns, strict=True))
        rows = rows.toDF(*given.values())
        made = []
        for f in table.schema:
            value = F.col(given[f.name]).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType)
            made.append((F.left(value, F.lit(table.lengths[f.name])) if f.name in table.lengths else value).alias(f.name))
        new = rows.select(*made)
        if needed := [f.name for f in table.schema if not f.nullable]:
            bad = F.lit(False)
            for c in needed:
                bad |= F.col(c).isNull()
            if not new.where(bad).isEmpty():
                raise ExecutionError(f"a NOT NULL column of {name} is null")
        n = new.count()
        self._swap(name, table.df.unionByName(new))
        return Result(message=f"Inserted {n} rows", affected_rows=n)

    def _do_insert(self, sql: str) -> Result:
        m = self._match(r"INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*)?((?:VALUES|SELECT|WITH)\b.*)", sql)
        columns = [c.strip().lower() for c in m[2].split(",")] if m[2] else [f.name for f in self._writable(m[1]).schema]
        if m[3][:6].upper() != "VALUES":
            return self._insert(m[1], self.query(m[3]), columns)
        t = Translator(m[3][6:], self._expression_type)
        rows: list[list[str]] = []
        while True:
            t.take("(")
            rows.append(t.items())
            t.take(")")
            if t.peek() != ",":
                break
            t.take(",")
        if wrong := [r for r in rows if len(r) != len(columns)]:
            raise SemanticError(f"{len(wrong[0])} values for {len(columns)} columns")
        kinds = {f.name: f.dataType.simpleString() for f in self._writable(m[1]).schema}
        if missing := [c for c in columns if c not in kinds]:
            raise SemanticError(f"{m[1]} has no column {missing[0]}")
        body = ", ".join("(" + ", ".join(f"CAST({x} AS {kinds[c]})" for x, c in zip(r, columns, strict=True)) + ")" for r in rows)
        return self._insert(m[1], self._run(f"VALUES {body}"), columns)

    def _do_update(self, sql: str) -> Result:
        m = self._match(r"UPDATE\s+(\w+)\s+SET\s+(.*)", sql)
        table = self._writable(m[1])
        self.types.clear()
        t, sets = Translator(m[2], self._expression_type, f"FROM {m[1].lower()}"), {}
        while True:
            column = t.take().strip('"').lower()
            if column not in {f.name for f in table.schema}:
                raise SemanticError(f"{m[1]} has no column {column}")
            t.take("=")
            sets[column] = t.expr().text
            if t.peek() != ",":
                break
            t.take(",")
        where = "true"
        if t.word() == "WHERE":
            t.take()
            where = t.expr().text
        hit = f"coalesce(({where}), false)"
        fields = ", ".join(f"CASE WHEN {hit} THEN CAST({sets[f.name]} AS {f.dataType.simpleString()}) ELSE `{f.name}` END AS `{f.name}`" if f.name in sets else f"`{f.name}`" for f in table.schema)
        n = self._run(f"SELECT count(*) FROM {m[1].lower()} WHERE {hit}").first()[0]
        if n:
            self._swap(m[1], self._run(f"SELECT {fields} FROM {m[1].lower()}"))
        return Result(message=f"Updated {n} rows", affected_rows=n)

    def _do_delete(self, sql: str) -> Result:
        m = self._match(r"DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?", sql)
        self._writable(m[1])
        self.types.clear()
        hit = f"coalesce(({Translator(m[2], self._expression_type, f'FROM {m[1].lower()}').expr().text}), false)" if m[2] else "true"
        n = self._run(f"SELECT count(*) FROM {m[1].lower()} WHERE {hit}").first()[0]
        if n:
            self._swap(m[1], self._run(f"SELECT * FROM {m[1].lower()} WHERE NOT {hit}"))
        return Result(message=f"Deleted {n} rows", affected_rows=n)

    def _do_copy(self, sql: str) -> Result:
        m = self._match(r"COPY\s+(\w+)\s+(FROM|TO)\s+'([^']*)'\s*(?:WITH\s*\((.*)\))?", sql)
        options = dict(re.findall(r"(\w+)\s+'?([^',)]+|,)'?", m[4] or ""))
        options = {k.upper(): v for k, v in options.items()}
        header, delimiter = options.get("HEADER", "true").lower() == "true", options.get("DELIMITER", ",")
        table = self._writable(m[1])
        if m[2].upper() == "TO":
            write_csv(table.df, m[3], True, delimiter)
            return Result(message=f"Copied to {m[3]}", affected_rows=table.df.count())
        rows, refused = read_csv(self.spark, m[3], table.schema, header, delimiter)
        done = self._insert(m[1], rows, [f.name for f in table.schema])
        return Result(message=f"Copied {done.affected_rows} rows, refused {refused}", affected_rows=done.affected_rows)

    def _do_explain(self, sql: str) -> Result:
        df = self.query(re.sub(r"^EXPLAIN\s+", "", sql, flags=re.I))
        text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result(self.spark.createDataFrame([(line,) for line in text.split("\n")], "Plan string"))

    def _do_vacuum(self, sql: str) -> Result:
        m = self._match(r"VACUUM(?:\s+(\w+))?", sql)
        for name in [m[1]] if m[1] else list(self.tables):
            self._swap(name, self._table(name).df)
        return Result(message="Vacuumed")

    def _do_analyze(self, sql: str) -> Result:
        return Result(self.analyze_table(self._match(r"ANALYZE(?:\s+TABLE)?\s+(\w+)", sql)[1]))

    def _do_begin(self, sql: str) -> Result:
        if self.saved is not None:
            raise ExecutionError("a transaction is open")
        self.saved = dict(self.tables)
        return Result(message="Begun")

    def _do_commit(self, sql: str) -> Result:
        if self.saved is None:
            raise ExecutionError("no transaction is open")
        self.saved = None
        return Result(message="Committed")

    def _do_rollback(self, sql: str) -> Result:
        if self.saved is None:
            raise ExecutionError("no transaction is open")
        self.tables, self.saved = self.saved, None
        return Result(message="Rolled back")

    # --- tools -----------------------------------------------------------------------------------------------

    def analyze_table(self, name: str, buckets: int = 10, common: int = 10) -> DataFrame:
        """column_name, row_count, null_count, n_distinct, min, max, avg_length, histogram of a table's columns, in one pass."""
        table, aggs = self._table(name), []
        for f in table.schema:
            c = F.col(f"`{f.name}`")
            numeric = isinstance(f.dataType, T.NumericType)
            bounds = F.percentile_approx(c.cast("double"), [k / buckets for k in range(buckets + 1)]) if numeric else F.lit(None).cast("array<double>")
            aggs.append(F.struct(F.lit(f.name).alias("column_name"), F.count("*").alias("row_count"), F.count_if(c.isNull()).alias("null_count"), F.approx_count_distinct(c).alias("n_distinct"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), F.avg(F.char_length(c.cast("string"))).alias("avg_length"), bounds.alias("histogram")))
        self.stats[name.lower()] = table.df.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")
        return self.stats[name.lower()]

    def get_table_stats(self, name: str) -> DataFrame | None:
        return self.stats.get(name.lower())

    def import_csv(self, path: str, name: str, delimiter: str = ",") -> Result:
        """A new table of text columns named by a file's header."""
        df = self.spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, nullValue="")
        self.create_table_from_schema(name, T.StructType([T.StructField(c.lower(), T.StringType()) for c in df.columns]))
        return self._insert(name, df, [c.lower() for c in df.columns])

    def export_csv(self, path: str, name: str) -> Result:
        return self._do_copy(f"COPY {name} TO '{path}'")

    def benchmark(self, sql: str, n: int = 5) -> dict[str, float]:
        """Seconds of n runs of a query, drained without a result: avg, min, max, p50, p95, p99, and queries a second."""
        took = []
        for _ in range(n):
            began = time.perf_counter()
            self.query(sql).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        at = lambda p: sorted(took)[min(n - 1, int(p * n))]
        return {"avg": statistics.mean(took), "min": min(took), "max": max(took), "p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "qps": n / sum(took)}

    def close(self) -> None:
        """Forget the tables; their files stay."""
        self.tables.clear()
