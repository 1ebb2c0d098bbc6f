"""Operators that compare documents, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontamination, near_duplicates, neighbours, substrings, warc
from tessella.llm.components import components, merged
from tessella.llm.words import word_fingerprints

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """Documents with exact copies, near copies, shared passages, runs, nulls and blanks."""
    dice = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage, out = [dice.choice(words) for _ in range(90)], []
    base = [dice.choice(words) for _ in range(120)]
    for k in range(n):
        kind = k % 6
        w = [dice.choice(words) for _ in range(dice.randrange(1, 160))]
        if kind == 1:
            a = dice.randrange(30)
            w = w[:40] + passage[a : a + dice.randrange(30, 60)] + w[40:]
        elif kind in (2, 3):
            w = list(base)
            for _ in range(dice.randrange(8)):
                w[dice.randrange(len(w))] = "edited"
        elif kind == 4:
            w = ["run"] * dice.randrange(30, 120) + w[:5]
        out.append((k, " ".join(w) if k % 17 else w[0].upper() + "\t" + "\n".join(w), "en", "s", 1))
    return [*out, (n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \n", "en", "s", 0), (n + 3, out[2][1], "en", "s", 1), (n + 4, "two words", "en", "s", 1), (n + 5, "two words", "en", "s", 1)]


def roots(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    up = {i: i for i in ids}

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text: str | None, width: int) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_fingerprints_equal_split() -> None:
    dice = random.Random(3)
    texts = [None if dice.random() < 0.1 else "".join(dice.choice("aAbé \t\n\x0b x") for _ in range(dice.randrange(40))) for _ in range(200)]
    found, ends = word_fingerprints(pa.array(texts), lower=True)
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert np.diff(ends, prepend=0).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(zip(words, found.tolist(), strict=True))) == len(set(words)) == len(set(found.tolist()))


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates(spark: SparkSession, seed: int) -> None:
    rows = corpus(seed)
    sets = {r[0]: shingles(r[1], 3) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    up = roots(list(sets), links)
    df = spark.createDataFrame([*rows, rows[2], (None, "alone", None, None, None)], DOCS)
    # A limit of 8 makes nodes branch and then be compared block against block.
    got = near_duplicates.near_duplicates(df.withColumn("kept", F.lit(1)), 3, 80, limit=8 if seed else near_duplicates.LIMIT).collect()
    assert {r.doc_id: r[1:] for r in got if r.doc_id is not None} == {i: (len(sets[i]), up[i], up[i] == i) for i in sets}
    assert len(got) == len(rows) + 2
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 1, None, True)]


@pytest.mark.parametrize("width", [8, 50])
def test_substrings(spark: SparkSession, width: int) -> None:
    rows, first, expected = corpus(4), {}, {}
    for i, text, *_ in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first.setdefault(tuple(w[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: tuple(r[1:]) for r in substrings.digests(df, width).collect()} == expected
    texts = {r.doc_id: r.text for r in substrings.remove_repeats(df, width).collect()}
    for i, text, *_ in rows:
        assert texts[i] == text or hashlib.sha256(" ".join((texts[i] or "").split()).encode()).hexdigest() == expected[i][2]
    assert substrings.digests(df.limit(0), width).count() == 0


def test_decontamination(spark: SparkSession) -> None:
    rows = [(*r[:1], (r[1] or "").replace("w1 ", "W1, ") if r[1] else r[1], *r[2:]) for r in corpus(5)]
    items = [(k, " ".join((rows[i][1] or "").split()[a : a + n])) for k, (i, a, n) in enumerate([(1, 10, 20), (1, 12, 9), (7, 0, 8), (2, 30, 12), (60, 0, 5), (64, 0, 2), (8, 3, 3)])] + [(50, None), (51, "!!"), (52, "nowhere to be found")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = {}
    for i, text, *_ in rows:
        w, hit, found = split(text), set(), set()
        for item, phrase in items:
            p = split(phrase)
            for window in {tuple(p[k : k + 8]) for k in range(max(1, len(p) - 7))} if p else ():
                for k in range(len(w) - len(window) + 1):
                    if tuple(w[k : k + len(window)]) == window:
                        hit.update(range(k, k + len(window)))
                        found.add(str(item))
        expected[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: tuple(r[1:]) for r in decontamination.contamination(df, bench).collect()} == expected
    assert {r.n_items for r in decontamination.contamination(df, bench.limit(0)).collect()} == {0}
    index = decontamination.build_index(df)
    phrases = decontamination.ranked(decontamination.phrases(bench).select("phrase").distinct(), index)
    assert decontamination.near(index, phrases, 20).count() >= decontamination.occurrences(index, phrases).count() > 0


def test_near_equals_brute_force(spark: SparkSession) -> None:
    dice = random.Random(5)
    docs = [(k, " ".join(dice.choice("abcdefg") for _ in range(dice.randrange(40)))) for k in range(60)]
    items = [(k, " ".join(dice.choice("abcdefgz" if k == 0 else "abcdefg") for _ in range(4))) for k in range(12)] + [(90, "a a b"), (91, "c")]
    index = decontamination.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rarest = decontamination.ranked(decontamination.phrases(spark.createDataFrame(items, "item_id long, text string"), 4).select("phrase").distinct(), index)
    term = {tuple(r.phrase): r.term for r in rarest.collect()}
    for span in (3, 5):
        got = {(r.doc_id, r.pos, tuple(r.phrase)) for r in decontamination.near(index, rarest, span).collect()}
        expected = set()
        for i, text in docs:
            words = text.split()
            for s in range(len(words)):
                window = words[s : s + span]
                for phrase, rare in term.items():
                    if all(window.count(t) >= phrase.count(t) for t in phrase):
                        expected |= {(i, s + k, phrase) for k, w in enumerate(window) if w == rare}
        assert got == expected
    near = decontamination.proximity(spark.createDataFrame([(1, "x b y a q"), (2, "b x x x x x x x x x x x x a"), (3, None), (None, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "a a")], "item_id long, text string"))
    assert sorted(map(tuple, near.collect()), key=str) == sorted([(1, 2), (2, 0), (3, 0), (None, 0)], key=str)


def test_components(spark: SparkSession) -> None:
    dice = random.Random(6)
    links = [(dice.randrange(80), dice.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(150, 200)]
    up = roots(sorted({x for e in links for x in e}), links)
    got = {r.id: r.root for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {i: up[i] for e in links if e[0] != e[1] for i in e}
    half = components(spark.createDataFrame(links[::2], "a long, b long"))
    assert {r.id: r.root for r in merged(half, spark.createDataFrame(links[1::2], "a long, b long")).collect()} == got


def test_warc(spark: SparkSession) -> None:
    long, page = "é" * 60, "x" * 99
    rows = [(3, "http://www.B.example:80/p?z&y#f", long, 1), (1, "https://a.example/", long, 1), (2, "https://a.example/", page, 1), (7, None, page, 1), (4, "u", None, 1), (5, "https://a.example/", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 5: ("revisit", 1), 2: ("response", None), 7: ("response", None), 4: ("response", None)}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert got[1].payload == long
    assert warc.url_key("http://www.B.example:80/p?z&y#f") == "example,b)/p?y&z"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_keeps_every_row(spark: SparkSession) -> None:
    odd = [f"http://a.example/x{c}y" for c in "\u2028\u2029\u0085"]
    rows = [(None, "http://a.example/", "no id"), (None, "http://a.example/", "no id, too"), (None, None, None), (7, "http://a.example/7", "first"), (7, "http://a.example/7", "second"), (7, "http://www.a.example/7", "third"), (7, "http://a.example/7", "first")]
    rows += [(20 + k, u, f"page {k}") for k, u in enumerate(odd)] + [(k, "http://b.example/", "z" * 200) for k in (None, 31, 30, 30)] + [(50, "http://b.example/many", f"{k}") for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted((str(i), len(h or ""), "revisit" if i == 31 else "response", "30" if i == 31 else "None") for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload) for r in got if r.page_id != 31) == sorted((str(i), h or "") for i, _, h in rows if i != 31)


def test_warc_captures_of_one_pair_go_on_over_blocks_and_files(spark: SparkSession, tmp_path: object) -> None:
    key = warc.url_key("http://a.example/")
    captures = [(key, i, "f", k, 1, "response") for k, i in enumerate([None] * 5200 + [1, 2])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    try:
        files = warc.write_index(spark.createDataFrame(captures, "key string, page_id long, file string, place long, size long, kind string"), f"{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1
    wanted = spark.createDataFrame([(None, "http://a.example/"), (None, "http://www.a.example/"), (2, "http://a.example/"), (3, "http://a.example/")], "page_id long, url string")
    got = sorted(((r.page_id, r.place) for r in warc.look_up(wanted, f"{tmp_path}/index", files).collect()), key=str)
    assert got == sorted([(None, k) for k in range(5200)] + [(2, 5201), (3, None)], key=str)


def test_warc_index_of_many_blocks(spark: SparkSession, tmp_path: object, monkeypatch: pytest.MonkeyPatch) -> None:
    captures = [(warc.url_key(f"http://h{k % 7}.example/{k}"), k, "f", k, 1, "response") for k in range(3000)]
    files = warc.write_index(spark.createDataFrame(captures, "key string, page_id long, file string, place long, size long, kind string"), f"{tmp_path}/index")
    reader = warc.IndexReader(f"{tmp_path}/index", files)
    assert all(reader.find(c[0], c[1]) == c[2:] for c in captures)
    assert reader.find("example,h1)/none", 1) is None


def test_neighbours(spark: SparkSession) -> None:
    dice = np.random.default_rng(7)
    vectors = dice.normal(size=(700, 16)).astype(np.float32)
    vectors[100:140] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        sims = np.round(unit @ unit[q], 12)
        sims[q] = -9
        best = np.lexsort((np.arange(700), -sims))[:5]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(abs(sims[v] - s) < 1e-9 for v, s in got[q])
    assert set(got) == set(range(0, 700, 50))
    assert hits >= 0.9 * 70
    assert [v for v, _ in got[50]] == [100, 101, 102, 103, 104]
    few = neighbours.nearest(df.where("vec_id < 3"), F.col("id") % 50 == 0).collect()
    assert len(few) == 2
    assert neighbours.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_pipeline(spark: SparkSession, tmp_path: object) -> None:
    rows = corpus(8)
    leaked = next(k for k in range(6, 60, 6) if len(rows[k][1].split()) >= 20)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, " ".join(rows[leaked][1].split()[k : k + 9])) for k in range(2)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in kept.collect()}
    assert {60, 61, 62} <= ids  # null and blank texts are clean
    assert leaked not in ids and 65 not in ids and 64 in ids
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == ids
    assert out[60] == 0
