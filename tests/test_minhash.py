"""The similarity join against brute force, on texts that are written out here."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import SparkSession

from tessella.operators import minhash
from tessella.plans import catalogue


def texts(seed: int) -> list[tuple]:
    """Copies, groups of near copies of all degrees, short texts, blanks and nulls."""
    dice = random.Random(seed)
    common, rare = [f"c{k}" for k in range(30)], [f"Word{k}" for k in range(3000)]
    out = [(k, t) for k, t in enumerate([None, "", " \t\n", "a b c d", "a b c d e", "A B\tC D E F", "b a d c c", "x", "X x", "x y"])]
    for group in range(12):
        base = dice.sample(rare, dice.choice([4, 9, 20, 60])) + dice.sample(common, 5)
        for _ in range(dice.choice([2, 3, 8, 30])):
            words = [w if dice.random() > 0.12 else dice.choice(rare) for w in base]
            dice.shuffle(words)
            out.append((len(out), " ".join(words + words[: dice.randrange(3)])))
        out.append((len(out), out[-1][1].upper()))
    return out


def links(rows: list[tuple], least: str) -> tuple[dict, dict, dict]:
    """Class of each id, and the sets and the similar pairs of classes by all-pairs comparison."""
    sets = {i: frozenset((t or "").lower().split()) for i, t in rows}
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i] or i, i)
    of = {i: first[sets[i] or i] for i in sets}
    reps = sorted(set(of.values()))
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in reps for b in reps if a < b and sets[a] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(least)}
    return of, sets, pairs


def counted(rows: list[tuple], least: str) -> set[tuple]:
    of, _, pairs = links(rows, least)
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    size = {c: sum(x == c for x in of.values()) for c in of.values()}
    return {(i, c, len(near.get(c, [])), sum(size[x] for x in near.get(c, []))) for i, c in of.items()}


def test_query_loses_no_link(spark: SparkSession, tmp_path: object) -> None:
    rows = texts(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in catalogue.queries()["sim_minhash_lsh"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    assert set(got) == counted(rows, "0.8")
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("least", ["0.5", "0.8", "1.0"])
def test_pairs_in_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, least: str) -> None:
    monkeypatch.setattr(minhash, "LIMIT", 7)
    rows = texts(6)
    got = minhash.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", float(least)).collect()
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(links(rows, least)[2])
    assert len({(r.a, r.b) for r in got}) == len(got)


def test_equal_hashes_in_a_sketch(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(minhash, "LIMIT", 40)
    rows = [(k, " ".join(f"w{k // 9}x{j if j != k % 9 else -k}" for j in range(12))) for k in range(90)]
    got = minhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 0.75)
    assert {tuple(r) for r in got.collect()} == counted(rows, "0.75")
