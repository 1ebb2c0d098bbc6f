"""A small interactive shell: statements end with a semicolon, commands begin with a dot."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator

from tessella.engine import Engine, Result
from tessella.session import get_spark

SHOWN = 100


def split_statements(text: str) -> Iterator[str]:
    """Statements of a text, parted at semicolons outside quotes and comments."""
    begin = 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|;", text, re.S):
        if m[0] == ";":
            if part := text[begin : m.start()].strip():
                yield part
            begin = m.end()
    if part := text[begin:].strip():
        yield part


class Shell:
    def __init__(self, engine: Engine, write: Callable[[str], object] = print) -> None:
        self.engine, self.write, self.timer, self.history, self.done = engine, write, True, [], False

    def show(self, result: Result) -> None:
        if result.df is None:
            self.write(result.message)
            return
        rows = result.df.limit(SHOWN + 1).collect()
        self.write(" | ".join(result.columns))
        for r in rows[:SHOWN]:
            self.write(" | ".join("NULL" if v is None else str(v) for v in r))
        if len(rows) > SHOWN:
            self.write(f"... the first {SHOWN} rows")

    def command(self, line: str) -> None:
        name, *args = line.split()
        e = self.engine
        if name == ".quit":
            self.done = True
        elif name == ".tables":
            self.write("\n".join(e.get_table_names()))
        elif name == ".schema":
            self.write("\n".join(f"{f.name} {f.dataType.simpleString()}" for f in e.get_table_schema(args[0])))
        elif name in (".analyze", ".stats"):
            found = e.analyze_table(args[0]) if name == ".analyze" else e.get_table_stats(args[0])
            self.show(Result(found) if found is not None else Result(message="not analysed"))
        elif name == ".import":
            self.show(e.import_csv(args[0], args[1]))
        elif name == ".export":
            self.show(e.export_csv(args[1], args[0]))
        elif name == ".benchmark":
            self.write(str(e.benchmark(line.split(None, 2)[2].rstrip(";"), int(args[0]))))
        elif name == ".timer":
            self.timer = args[:1] != ["off"]
        elif name == ".history":
            self.write("\n".join(self.history[-int(args[0]) if args else 0 :]))
        elif name == ".vacuum":
            self.show(e.execute("VACUUM"))
        else:
            self.write("commands: .tables .schema t .analyze t .stats t .import file t .export t file .benchmark n sql .timer on|off .history [n] .vacuum .quit")

    def run(self, text: str) -> None:
        if text.lstrip().startswith("."):
            self.command(text.strip())
            return
        for statement in split_statements(text):
            self.history.append(statement)
            began = time.perf_counter()
            self.show(self.engine.execute(statement))
            if self.timer:
                self.write(f"({time.perf_counter() - began:.3f} s)")


def main() -> None:
    shell, held = Shell(Engine(get_spark("shell"))), ""
    for line in sys.stdin:
        held += line
        if not held.strip() or (not held.lstrip().startswith(".") and not held.rstrip().endswith(";")):
            continue
        try:
            shell.run(held)
        except Exception as e:  # the shell goes on after any failed statement
            print(f"{type(e).__name__}: {str(e).splitlines()[0]}")
        held = ""
        if shell.done:
            break


if __name__ == "__main__":
    main()
