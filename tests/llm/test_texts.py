"""Operators on single texts: BPE, chat formatting, toxicity."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import sys
import tracemalloc
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from tessella.llm import bpe, chat, queries, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = '\u2028"\\ ### Assistant: </turn>\n\x01é'
TRICKY = ["", " \n", "Hello, World's 123²!", "we'll've 'S", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ İstanbul ﬁ é", "x\x1cy z", "a" * 3000, "!?" * 400, "日本語 текст", "🙂👍🏽"]


@pytest.fixture(scope="module")
def model() -> bpe.WordBpe:
    with open(PATH, "rb") as f:
        return bpe.WordBpe.from_json(f.read())


def test_bpe_equals_library(model: bpe.WordBpe) -> None:
    library, dice = Tokenizer.from_file(PATH), random.Random(0)
    fuzz = ["".join(dice.choice("abcdeé'ß ñ\t<|>endoftext12中!") for _ in range(dice.randrange(60))) for _ in range(800)]
    for text in TRICKY + fuzz:
        ids, decimal = model.encode(text)
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert decimal == " ".join(map(str, expected))
        assert model.decode(ids).decode() == library.decode(expected, skip_special_tokens=False)


def test_bpe_compatibility_is_that_of_merging(model: bpe.WordBpe) -> None:
    library, dice = Tokenizer.from_file(PATH), random.Random(1)
    for _ in range(300):
        word = "".join(dice.choice("aeinorst") for _ in range(dice.randrange(2, 14)))
        ids = model.encode_word(word)
        assert ids == library.encode(word, add_special_tokens=False).ids
        assert all(model.compatible(x, y) for x, y in zip(ids, ids[1:], strict=False))


def test_bpe_encodes_a_word_once_whatever_stands_about_it(monkeypatch: pytest.MonkeyPatch) -> None:
    met, encode = [], bpe.WordBpe.encode_word
    monkeypatch.setattr(bpe.WordBpe, "encode_word", lambda self, word: met.append(word) or encode(self, word))
    with open(PATH, "rb") as f:
        fresh = bpe.WordBpe.from_json(f.read())
    text = "thaner Thaner, thaner. (thaner) «thaner» éthaner éthaner!"
    assert fresh.encode(text)[0].tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert met.count("thaner") == met.count("éthaner") == 1


def test_bpe_tables(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "Two words", 7), (3, "Two words", 7), (None, "x", 8)], "doc_id long, text string, n_tokens int")
    got = sorted(bpe.round_trip(docs, PATH).select("doc_id", "n_tokens", "decoded_sha256").collect(), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(1, 0, sha("")), (2, 0, sha("")), (3, 2, sha("two</w> words</w>")), (3, 2, sha("two</w> words</w>")), (None, 1, sha("x</w>"))], key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).where("doc_id = 3").first()
    assert back.text == "two</w> words</w>"
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_chat_template_is_reversible() -> None:
    dice = random.Random(2)
    bits = ["\\", "#", "###", " </turn>", "</turn>\n", "\n", "a", ": ", "### Assistant: ", " "]
    for _ in range(1500):
        turns = [("".join(dice.choice(["user", "assistant", ":", "\\", "### "]) for _ in range(dice.randrange(3))), "".join(dice.choice(bits) for _ in range(dice.randrange(9)))) for _ in range(dice.randrange(5))]
        formatted = "".join(chat.format_turn(*t)[0] for t in turns)
        assert [t[:2] for t in chat.read_turns(formatted)] == turns


def test_chat_tables(spark: SparkSession) -> None:
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", None), (2, 0, None, "q"), (2, None, "user", "first"), (None, 0, "user", "n")]
    got = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("user\n\\### Assistant: </turn> ok\nassistant\nyes\nassistant\n\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (3, sha("yes"))
    assert got[2].turns_sha256 == sha("user\nfirst\n\nq\n")
    assert len(got) == 3
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_layouts(spark: SparkSession) -> None:
    rows = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, {"instruction": "a", "input": "", "output": "b", "id": 3}, {"prompt": "a", "completion": "b"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "z"}]}, {"other": 1}, [1],
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)] + [(9, "no json"), (10, None)], "id int, raw string")
    got = {r.conv_id: r for r in chat.parse_layouts(df, "id", "raw").collect()}
    assert [got[k].layout for k in (0, 1, 2, 3, 4, 5, 9, 10)] == ["messages", "instruction", "prompt", "conversations", None, None, None, None]
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "q"), ("assistant", "z")]


def test_chat_goes_through_layouts(spark: SparkSession, tmp_path: object, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(k, t, r, x) for k in (0, 1, 2, -4, None) for t, r, x in [(0, "user", ""), (1, "assistant", HARD), (2, "human", None), (None, None, "first"), (1, "assistant", HARD)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    layouts = {r.layout for r in chat.parse_layouts(chat.in_layouts(turns), "id", "raw").collect()}
    assert layouts == {"messages", "conversations", "turns"}
    back = chat.from_layouts(chat.in_layouts(turns))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t, r or "", x or "") for i, t, r, x in rows), key=str)
    assert sorted(chat.digests(back).collect(), key=str) == sorted(chat.digests(turns).collect(), key=str)
    assert chat.canonical({"prompt": "", "completion": "b"}, next(x for x in chat.LAYOUTS if x.name == "prompt")) == [("user", ""), ("assistant", "b")]
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    seen = []
    monkeypatch.setattr(chat, "parse_layouts", lambda *a, f=chat.parse_layouts: seen.append(a) or f(*a))
    assert queries.op10_chat(spark, str(tmp_path)).count() == 6 and seen


INSULTS = ("idiot", "stupid", "trash")


def prose(dice: random.Random, n: int) -> list[str]:
    return ["".join(dice.choice(["an", "er", "on", "tha", "re", "ed", "be", "ing"]) for _ in range(dice.randrange(1, 4))) for _ in range(n)]


def labelled(spark: SparkSession, n: int, extra: list[tuple]) -> tuple:
    """Every fourth document has one or two insults among invented words."""
    dice, rows = random.Random(3), []
    for k in range(n):
        words = prose(dice, dice.randrange(8, 40))
        for _ in range(dice.randrange(1, 3) if k % 4 == 0 else 0):
            words.insert(dice.randrange(len(words)), dice.choice(INSULTS))
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(n)], "doc_id long, toxic int")


def test_toxic_words_are_restored(spark: SparkSession) -> None:
    spaced = " ".join("ban" * 40)
    extra = [(900, "1d10t here"), (901, "s t u p i d"), (902, "stuuupid!"), (903, "plain bane thaner"), (904, None), (905, f"{spaced} s t u p i d {spaced}"), (906, "thaner bane " * 90_000 + "idiot stupid trash"), (None, "")]
    docs, labels = labelled(spark, 400, extra)
    got = {r.doc_id: r for r in toxicity.scores(docs.withColumn("score", docs.doc_id), labels).collect()}
    assert [got[k].predicted for k in (0, 900, 901, 902, 905, 906)] == [1] * 6
    assert [got[k].predicted for k in (1, 903, 904, None)] == [0, 0, 0, 0]
    assert got[904].score == got[None].score == min(r.score for r in got.values())
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in toxicity.scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_toxicity_copies_and_clashing_labels_fit_alike(spark: SparkSession) -> None:
    docs, labels = labelled(spark, 200, [])
    copies = docs.selectExpr("doc_id + 1000 as doc_id", "text")
    more = labels.where(~toxicity.held_out()).selectExpr("doc_id + 1000 as doc_id", "0 as toxic")
    once = {r.doc_id: r.predicted for r in toxicity.scores(docs, labels).collect()}
    twice = toxicity.scores(docs.union(copies).union(docs), labels.union(more)).collect()
    assert {r.doc_id: r.predicted for r in twice if r.doc_id < 1000} == once
    assert sum(once.values()) >= 45


def test_learning_holds_no_more_than_it_counts_at_once(monkeypatch: pytest.MonkeyPatch) -> None:
    dice = random.Random(7)
    words = ["".join(dice.choice("aeinrst") for _ in range(12)) for _ in range(12_000)]
    rows = [(k, " ".join(words[k * 40 : k * 40 + 60]) + " 1d10t s t u p i d", k % 2) for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["doc_id", "text", "toxic"])
    run = toxicity._learned(SimpleNamespace(value=toxicity.trigrams("idiot stupid retain " * 9)))

    def sums() -> tuple[dict[str, np.ndarray], int]:
        out: dict[str, np.ndarray] = {}
        tracemalloc.start()
        most = 0
        for part in run(iter([batch])):
            most = max(most, tracemalloc.get_traced_memory()[1])
            for f, *x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out[f] = out.get(f, 0) + np.hstack(x)
            tracemalloc.reset_peak()
        tracemalloc.stop()
        return out, most - sum(sys.getsizeof(x) + sys.getsizeof(k) for k, x in out.items()) - sys.getsizeof(out)

    whole, _ = sums()
    assert whole[""].tolist()[:6] == [150] * 6
    assert whole["idiot"].tolist()[:6] == [150, 0, 0] * 2
    monkeypatch.setattr(toxicity, "MOST_COUNTED", 2000)
    parts, held = sums()
    assert parts.keys() == whole.keys() and all((parts[f] == n).all() for f, n in whole.items())
    assert held < 6 << 20


def test_lattice_search_is_exact() -> None:
    keys, counts = toxicity.trigrams("idiot stupid trash total soil illegal easel gas bag " * 9 + "lot oil zeal")
    model, dice = toxicity.CharacterModel(keys, counts), random.Random(5)
    restorer = toxicity.Restorer(model)

    def value(path: tuple) -> float:
        code = [toxicity.BLANK] * 2 + [toxicity.letter(x) for x, _ in path if x] + [toxicity.BLANK]
        return sum(cost for _, cost in path) + sum(model(*code[k : k + 3]) for k in range(len(code) - 2))

    for _ in range(200):
        token = "".join(dice.choice("idotsla14$!0.-|8e") for _ in range(dice.randrange(1, 9)))
        paths = itertools.product(*[restorer.options(token, k) for k in range(len(token))])
        best: dict[str, float] = {}
        for path in paths:
            word = "".join(x for x, _ in path)
            best[word] = max(best.get(word, -1e9), value(path))
        best.pop("", None)
        if best:
            assert best[restorer.viterbi(token)[0]] == pytest.approx(max(best.values()))


def test_trigrams_do_not_depend_on_pieces(monkeypatch: pytest.MonkeyPatch) -> None:
    text = "Thé quick  brownfox日本 jumps" * 50 + "x" * 300
    whole = dict(zip(*map(list, toxicity.trigrams(text)), strict=True))
    monkeypatch.setattr(toxicity, "PIECE", 64)
    parts: dict[int, int] = {}
    for piece in toxicity.pieces([text]):
        for key, n in zip(*toxicity.trigrams(piece), strict=True):
            parts[key] = parts.get(key, 0) + n
    assert {k for k in whole} <= set(parts)
