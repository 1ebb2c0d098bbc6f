"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The encoder never replays merges. An Aho-Corasick automaton over the vocabulary gives a word's
longest tokens one after another, and the longest token from any other place when the walk comes
there; a left-to-right walk takes it and steps to the token's next shorter prefix, or back to the
place before, when the pair (previous token, token) could not stand side by side in a merged word. Whether it can is looked up in the table of merges:
two tokens are compatible if undoing them towards their common border, latest merge first, never
meets a merge that would have joined them earlier. That gives exactly the merges of BPE in time
linear in the word, as each place is given up at most once.

Words recur, with and without punctuation about them, so each task keeps bounded memos from stretch and word to
its tokens in decimal, and drops them at its end.

Edge cases: a null text counts as empty and has no tokens; strings of special tokens inside a
text become those tokens, as in the tokenizers library; equal rows give equal results; other
columns of the input are ignored, whatever their names, unless asked to be kept. Character classes
are those of the installed regex module; the library's differ for code points that its older
Unicode tables don't assign.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tessella.llm.common import map_batches, texts

#: Entries of a generation of a worker's memos: stretches between white space, words, pairs of tokens.
MEMO_STRETCHES, MEMO_WORDS, MEMO_PAIRS = 150_000, 150_000, 100_000
#: Longer words aren't kept.
MEMO_LENGTH = 64
END = "</w>"
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Lower-case letters that every Unicode table has: a stretch of them is one word.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the rest follows from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return {b: chr(b) for b in kept} | moved


class Memo(dict):
    """What a worker has met, in two generations: a full one becomes the older, what it still holds is taken up again when met."""

    def __init__(self, make: Callable, most: int) -> None:
        self.make, self.most, self.older = make, most, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        if (found := self.older.get(key)) is None:
            found = self.make(key)
            if type(key) is str and len(key) > MEMO_LENGTH:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


@dataclass
class WordBpe:
    """A vocabulary with word ends: every atom is a byte letter, or a byte letter that ends its word."""

    tokens: list[str]
    parts: list[tuple[int, int]]
    rank: list[int]
    joined: dict[tuple[int, int], int]
    specials: dict[str, int]
    pattern: str
    memo: Memo = field(init=False)
    memo_words: Memo = field(init=False)
    memo_pairs: Memo = field(init=False)

    @classmethod
    def from_json(cls, blob: bytes) -> WordBpe:
        spec = json.loads(blob)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *specials.values()]) + 1
        tokens = [""] * size
        for text, i in (vocab | specials).items():
            tokens[i] = text
        parts, rank, joined = [(i, i) for i in range(size)], [-1] * size, {}
        for at, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            joined.setdefault((a, b), c)
            if rank[c] < 0:
                rank[c], parts[c] = at, (a, b)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        out = cls(tokens, parts, rank, joined, specials, split["pattern"]["Regex"])
        out._index()
        return out

    def _index(self) -> None:
        self.memo = Memo(self._stretch, MEMO_STRETCHES)
        self.memo_words = Memo(self._word, MEMO_WORDS)
        self.memo_pairs = Memo(lambda pair: self.compatible(*divmod(pair, len(self.tokens))), MEMO_PAIRS)
        letters = byte_letters()
        self.atom = {letters[b]: chr(b) for b in range(256)}
        self.words = regex.compile(self.pattern, regex.V0)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.decimal = [str(i) for i in range(len(self.tokens))]
        reserved = set(self.specials.values())
        self.automaton = ahocorasick.Automaton()
        self.length, self.shorter = [0] * len(self.tokens), [-1] * len(self.tokens)
        spelled: dict[str, int] = {}
        for i, text in enumerate(self.tokens):
            if i not in reserved and text:
                spelled[self._spell(text)] = i
        for word, i in spelled.items():
            self.length[i] = len(word)
            self.shorter[i] = next((spelled[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in spelled), -1)
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        pieces = [t.encode() for t in self.tokens]
        self.blob = np.frombuffer(b"".join(p + b" " for p in pieces), dtype=np.uint8)
        self.sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def _spell(self, token: str) -> str:
        """A token as letters below 512: bytes, and bytes that end the word from 256 on."""
        end = token.endswith(END) and token != END
        body = [self.atom[c] for c in (token[: -len(END)] if end else token)]
        if end and body:
            body[-1] = chr(256 + ord(body[-1]))
        return "".join(body)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when the word is merged in rank order."""
        ceiling = len(self.tokens) * 2
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and self.rank[whole] < ceiling:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            # Undo whichever was made last; at equal ranks the left one, as merges run left to right.
            if a > b or (a == b and left == right and b < 0):
                ceiling, left = a, self.parts[left][1]
            else:
                ceiling, right = b + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode()
        spelled = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        n, lengths, shorter, pairs, size = len(spelled), self.length, self.shorter, self.memo_pairs, len(self.tokens)
        best = [-2] * (n + 1)  # not looked up
        best[n] = -1
        for end, token in self.automaton.iter_long(spelled):
            best[end - lengths[token] + 1] = token
        open_end, out, at, last, token = bytearray(b"\x01" * (n + 1)), [], 0, -1, self._longest(spelled, 0, best)
        while at < n:
            while token >= 0 and not (open_end[at + lengths[token]] and (last < 0 or pairs[last * size + token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                last = token
                if (token := best[at]) == -2:
                    token = self._longest(spelled, at, best)
            elif out:
                open_end[at] = 0
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
            else:
                raise ValueError(f"the vocabulary can't spell {word[:40]!r}")
        return out

    def _longest(self, spelled: str, at: int, best: list[int]) -> int:
        """The longest token that starts at a place, -1 without one."""
        if best[at] == -2:
            end, token = next(self.automaton.iter_long(spelled, at), (-1, -1))
            best[at] = token if token >= 0 and end - self.length[token] + 1 == at else -1
        return best[at]

    def _word(self, word: str) -> str:
        return " ".join([self.decimal[i] for i in self.encode_word(word)])

    def _stretch(self, stretch: str) -> str:
        if PLAIN.fullmatch(stretch):
            return self.memo_words[stretch]
        return " ".join(map(self.memo_words.__getitem__, self.words.findall(stretch)))

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Token ids, and the same in decimal joined by single spaces."""
        found: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                found.append(self.decimal[self.specials[part]])
            elif part:
                if not part.isascii():
                    # The library lowers character by character, so a final capital sigma has no form of its own.
                    part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
                # No word crosses white space. Python also splits at four separators that are none for the pattern.
                part = part.lower()
                found += map(self.memo.__getitem__, [part] if SEPARATORS.search(part) else part.split())
        decimal = " ".join(filter(None, found))
        return np.fromstring(decimal, dtype=np.int32, sep=" "), decimal

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens joined by single spaces, gathered through the offset table in one step."""
        if not len(ids):
            return b""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.sizes[ids]
        starts = np.cumsum(sizes) - sizes
        return self.blob[np.repeat(self.offsets[ids] - starts, sizes) + np.arange(int(sizes.sum()))][:-1].tobytes()


_by_digest: dict[str, WordBpe] = {}


def _forget() -> None:
    """At a task's end: workers are reused, and what they remember is memory of their executor."""
    for model in _by_digest.values():
        for memo in (model.memo, model.memo_words, model.memo_pairs):
            memo.forget()


def _held(vocabulary: Broadcast, digest: str) -> WordBpe:
    """One model for each Python worker and vocabulary; workers are reused over tasks."""
    if digest not in _by_digest:
        _by_digest[digest] = WordBpe.from_json(vocabulary.value)
    return _by_digest[digest]


def _shipped(df: DataFrame, path: str) -> tuple[Broadcast, str]:
    """The vocabulary file as a broadcast: its size is that of one file and doesn't depend on the data."""
    with open(path, "rb") as f:
        blob = f.read()
    return df.sparkSession.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest()


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, token_ids array<int>`` of each row of ``df``."""
    vocabulary, digest = _shipped(df, path)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        model = _held(vocabulary, digest)
        found = [model.encode(t)[0] for t in texts(rows.column(1))]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        flat = np.concatenate(found) if found else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], [id_col, "token_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), batch, f"`{id_col}` {kind}, token_ids array<int>", after=_forget)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id_col, text`` of each row of ``df``; a null list counts as empty."""
    vocabulary, digest = _shipped(df, path)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        model = _held(vocabulary, digest)
        found = [model.decode(np.array(x or [], dtype=np.int64)).decode() for x in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, ids_col), batch, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep``, then n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass.

    Fused so that ids, several times the size of the digests, never leave the Python worker.
    """
    vocabulary, digest = _shipped(df, path)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        model = _held(vocabulary, digest)
        counts, ids_sha, out_sha = [], [], []
        for text in texts(rows.column(len(keep))):
            ids, decimal = model.encode(text)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
            out_sha.append(hashlib.sha256(model.decode(ids)).hexdigest())
        made = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
        return pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *made], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(df.select(*keep, text_col), batch, f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", after=_forget)
