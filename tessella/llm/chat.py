"""Chat formatting: layouts found by schema fingerprints, turns in a reversible template.

Rows in prompt, instruction or message layouts come as JSON. The fingerprint of a row is a hash of its
nested field paths (names and kinds, array places left out, sorted); it selects a declarative mapping
that says where turns, roles and texts are. A mapping covers all fingerprints whose paths include its own,
so optional extra fields don't matter; the mapping with the most paths wins, ties go to the first declared.

The template writes each turn as ``### Role: text </turn>`` with the markers below. A backslash is put before
every backslash of a text and before every marker's first character, so that no marker occurs inside a
text; reading takes it away again. The loss mask is the text of assistant turns as it stands in the output.

Conversations of any length stream through one pass: turns are dealt by conversation, sorted by turn
inside each partition, and hashed as they pass. Nothing of a conversation is gathered.

Edge cases: null texts and roles count as empty; rows of one conversation with equal turns are ordered by role
and text; repeated rows are repeated turns; null conversation ids form one conversation; null turns come
first; other columns are ignored. A JSON row that no mapping fits yields no turns and is reported with a
null layout.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
#: What must not occur inside a text or role: the escape itself, and the first character of each marker.
CONTROL = regex.compile(r"\\|###|</turn>")
ROLE_CONTROL = regex.compile(r"\\|###|</turn>|:")
ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)
TURN = regex.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", regex.DOTALL)


def escape(text: str, control: regex.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head = OPEN + escape(role, ROLE_CONTROL) + COLON
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the span of the escaped text, of every turn of a formatted conversation."""
    at = 0
    while at < len(formatted):
        if (m := TURN.match(formatted, at)) is None:
            raise ValueError(f"no turn at character {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


@dataclass(frozen=True)
class Layout:
    """Where a JSON layout keeps its turns.

    turns: path of the array of turns, with the fields of role and text in each; or pairs of
    (role, path) that are turns by themselves, left out when missing or empty unless the layout requires them.
    """

    name: str
    array: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()


USUAL_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("prompter", "user"))
LAYOUTS = (
    Layout("messages", array="messages", role="role", text="content", roles=USUAL_ROLES, required=("messages[].content:s", "messages[].role:s")),
    Layout("conversations", array="conversations", role="from", text="value", roles=USUAL_ROLES, required=("conversations[].from:s", "conversations[].value:s")),
    Layout("turns", array="turns", role="role", text="text", roles=USUAL_ROLES, required=("turns[].role:s", "turns[].text:s")),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), required=("instruction:s", "output:s")),
    Layout("prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), required=("completion:s", "prompt:s")),
    Layout("question", fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response")), required=("question:s", "response:s")),
)


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths with kinds: s string, n number, b boolean, 0 null, {} and [] for empty ones."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {f"{at}:{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}:[]"}
    kind = "s" if isinstance(value, str) else "b" if isinstance(value, bool) else "0" if value is None else "n"
    return {f"{at}:{kind}"}


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


class Selector:
    """Layouts by fingerprint; a fingerprint is matched with the declared paths once."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS) -> None:
        self.layouts, self.known = layouts, {}

    def __call__(self, value: object) -> tuple[str, Layout | None]:
        found = paths(value)
        key = fingerprint(found)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            fit = [x for x in self.layouts if found.issuperset(x.required)]
            self.known[key] = max(fit, key=lambda x: len(x.required)) if fit else None
        return key, self.known[key]


def canonical(value: dict, layout: Layout) -> list[tuple[str, str]]:
    """Turns as (role, text) by a layout's mapping."""
    named = dict(layout.roles)
    say = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if layout.array:
        rows = [t for t in value.get(layout.array) or [] if isinstance(t, dict)]
        return [(named.get(r := say(t.get(layout.role)), r), say(t.get(layout.text))) for t in rows]
    # A field that the layout requires is a turn even if it is empty.
    needed = {r.rpartition(":")[0] for r in layout.required}
    return [(role, say(value[f])) for role, f in layout.fields if f in needed or value.get(f) not in (None, "")]


def parse_layouts(df: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, fingerprint, layout, turns array<struct<turn, role, text>> of rows of JSON in any declared layout."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = Selector(layouts)
        schema = pa.schema([("fingerprint", pa.string()), ("layout", pa.string()), ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))])
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                try:
                    value = json.loads(raw or "")
                except ValueError:
                    value = None
                key, layout = choose(value) if isinstance(value, dict) else (None, None)
                turns = canonical(value, layout) if layout else []
                rows.append({"fingerprint": key, "layout": layout and layout.name, "turns": [{"turn": k, "role": r, "text": t} for k, (r, t) in enumerate(turns)]})
            made = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], ["conv_id", *schema.names])

    return df.select(id_col, json_col).mapInArrow(run, f"conv_id {kind}, fingerprint string, layout string, turns array<struct<turn bigint, role string, text string>>")


#: The layouts of arrays for turns whose roles are canonical already: none is renamed.
AS_NAMED = tuple(replace(x, roles=()) for x in LAYOUTS if x.array)


def in_layouts(turns: DataFrame) -> DataFrame:
    """id (conv_id, turn), raw of every row: the turn as JSON, in a layout that depends on its conversation.

    A row holds one turn of its conversation, so that a conversation's length doesn't matter.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    made = [F.to_json(F.struct(F.array(F.struct(role.alias(x.role), text.alias(x.text))).alias(x.array))) for x in AS_NAMED]
    pick = F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.lit(len(made)))
    raw = made[-1]
    for k, json_text in enumerate(made[:-1]):
        raw = F.when(pick == k, json_text).otherwise(raw)
    return turns.select(F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).alias("id"), raw.alias("raw"))


def from_layouts(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``in_layouts`` rows, by the mapping that each row's fingerprint selects; a row that no mapping fits is an error."""
    found = parse_layouts(rows, "id", "raw", AS_NAMED)
    fit = F.when(F.col("layout").isNotNull(), F.col("turns")).otherwise(F.raise_error(F.lit("no layout fits a turn")))
    said = found.select("conv_id", F.explode(fit).alias("t"))
    return said.select(F.col("conv_id.conv_id").alias("conv_id"), F.col("conv_id.turn").alias("turn"), "t.role", "t.text")


def _ordered(turns: DataFrame) -> DataFrame:
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    return turns.select(*cols).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_begin, loss_end of every row: a conversation's text is its turns' joined in order.

    The mask is empty (both null) outside assistant turns. Rows lie by conversation and turn in each partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            mine = [r == "assistant" for r in b.column(2).to_pylist()]
            spans = [[m[k] if own else None for m, own in zip(made, mine, strict=True)] for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m[0] for m in made], pa.string()), *(pa.array(s, pa.int64()) for s in spans)], ["conv_id", "turn", "formatted", "loss_begin", "loss_end"])

    return _ordered(turns).mapInArrow(run, "conv_id bigint, turn bigint, formatted string, loss_begin bigint, loss_end bigint")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_id, n, loss, size = (), 0, 0, 0
        whole = masked = None
        row = lambda: (open_id[0], n, whole.hexdigest(), loss, masked.hexdigest(), size)
        for b in batches:
            done = []
            for conv, formatted, begin, end in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if open_id != (conv,):
                    if open_id:
                        done.append(row())
                    open_id, n, loss, size, whole, masked = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                size += len(formatted)
                for role, text, _, _ in read_turns(formatted):
                    n += 1
                    whole.update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    text = unescape(formatted[begin:end])
                    loss += len(text)
                    masked.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if open_id:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(), kinds, strict=True)], names)

    # The partitions and their order are those of format_conversations; nothing is dealt again.
    return format_conversations(turns).mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
