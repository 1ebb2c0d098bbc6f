"""Removal of long passages that another document has too, found by recompression.

A document is a sequence of words. Rounds shorten it: a run of one symbol becomes a symbol for its
inner part, then a symbol of class 0 followed by one of class 1 become a symbol for the pair. A
symbol's name and class are fingerprints of its content, so every executor gives the same name to
the same runs and pairs without an exchange, and two occurrences of a passage are parsed alike except
near their ends. How far "near" reaches follows from the passage alone: in each round its first
symbol may have paired with what stands before it only if it is of class 1, its last only if it is of
class 0, and a run that touches an end may go on outside. What is left inside is the same wherever the
passage stands. Every window of ``width`` words therefore has an anchor that depends on its words
only: the first inner symbol of the highest round that still has one, or the window's own fingerprint
if there is none (a long run, say).

1. Each document's anchors, with the stretch of windows that share it, in one pass over the texts.
2. Spark finds the anchors that at least two documents have. Only their windows can repeat.
3. Those windows are compared by 128-bit fingerprints of all their words: a window goes if a
   document with a smaller id has it too.
4. Documents that lost words are cut; the others pass as they are.

Equal word sequences are settled first: all but the one with the smallest id lose every window, and
so every word, if they have ``width`` words; they take no part in the steps above.

Edge cases: null and empty texts have no words and lose none; documents shorter than ``width`` lose
nothing; a repetition inside one document doesn't count; rows with one id are one document for
comparisons and must hold one text (each is returned), and a null id takes part in nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, map_batches, materialise, mix64, release
from tessella.llm.words import raw_texts, window_names, word_fingerprints

#: Rounds of pairing; a round leaves about three quarters of the symbols.
ROUNDS = 8
U = np.uint64


def _spread(ends: np.ndarray) -> np.ndarray:
    """The document of each word, from the documents' ends."""
    return np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))


def anchors(words: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of several documents laid end to end: document, name, first window, number of windows.

    Windows are numbered from the start of the whole; ``ends`` are where documents end.
    """
    owner = _spread(ends)
    n = len(words)
    if n < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    first = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    symbols, own = mix64(words), owner
    # The inner symbols of each window that still has two or more: low <= k < high.
    live, low, high = np.arange(len(first)), first.astype(np.int32), (first + width).astype(np.int32)
    name, bare = np.empty(len(first), U), np.ones(len(first), bool)
    with np.errstate(over="ignore"):
        for r in range(1, ROUNDS + 1):
            if not len(live):
                break
            m = len(symbols)
            # Where an inner part moves that begins, or ends, at a symbol: first past a run that shows there.
            begin, end = np.arange(m + 1, dtype=np.int32), np.arange(1, m + 1, dtype=np.int32)
            same = (symbols[1:] == symbols[:-1]) & (own[1:] == own[:-1])
            keep = np.ones(m, bool)
            if same.any():
                head = np.flatnonzero(np.concatenate(([True], ~same)))
                tail = np.concatenate((head[1:], [m])) - 1
                many = np.flatnonzero(tail > head)
                h, t = head[many], tail[many]
                size = t - h + 1
                inside = np.repeat(h - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
                begin[inside], end[inside] = np.repeat(t, size), np.repeat(h + 1, size)
                begin[t], end[h] = t, h + 1
                # A run's first and last symbols stay, so that a run of which one symbol shows looks like none.
                wide = size > 2
                symbols = symbols.copy()
                symbols[h[wide] + 1] = mix64(symbols[h[wide] + 1] * U(0xD6E8FEB86659FD93) + size[wide].astype(U) * U(2) + U(1))
                keep[inside] = False
                keep[h] = keep[t] = True
                keep[h[wide] + 1] = True
            at = np.flatnonzero(keep)
            symbols, own = symbols[at], own[at]
            # Then past a symbol that may have paired with one outside.
            right = (mix64(symbols ^ U(r * 0x632BE59BD9B4E019 % 2**64)) >> U(17)) & U(1) == 1
            pair = np.flatnonzero(~right[:-1] & right[1:] & (own[1:] == own[:-1]))
            stays = np.ones(len(at), bool)
            stays[pair + 1] = False
            to = np.zeros(len(at) + 1, np.int32)
            np.cumsum(stays, out=to[1:])
            kept = np.zeros(m + 1, np.int32)
            np.cumsum(keep, out=kept[1:])
            more, less = np.append(right, False).astype(np.int32), np.append(False, ~right).astype(np.int32)
            k = kept[begin]
            begin = to[np.minimum(k + more[k], len(at))]
            k = kept[end]
            end = to[k - less[k]]
            symbols[pair] = mix64(symbols[pair] * U(0xA0761D6478BD642F) ^ (symbols[pair + 1] + U(0xE7037ED1A0B428DB)))
            symbols, own = symbols[stays], own[stays]
            low, high = begin[low], end[high - 1]
            full = high > low
            if not full.all():
                live, low, high = live[full], low[full], high[full]
            name[live], bare[live] = symbols[low] + U(r), False
            if not (two := high - low > 1).all():
                live, low, high = live[two], low[two], high[two]
    name = mix64(name)
    if bare.any():
        name[bare] = window_names(words, width, 3)[first[bare]]
    new = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (first[1:] != first[:-1] + 1)))) if len(first) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((new, [len(first)])))
    return owner[first[new]], name[new], first[new], size


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _sketch(width: int):
    """doc_id, n_words, sequence digest, digest of the whole text's words, anchors (name, first window, windows)."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = word_fingerprints(rows.column(1), lower=False)
        doc, name, first, size = anchors(flat, ends, width)
        counts = np.diff(ends, prepend=0)
        starts = ends - counts
        joined = [hashlib.sha256(b" ".join(t.split())) for t in raw_texts(rows.column(1))]
        found = pa.StructArray.from_arrays([pa.array(name.view(np.int64)), pa.array((first - starts[doc]).astype(np.int32)), pa.array(size.astype(np.int32))], ["name", "first", "size"])
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(counts, pa.int64()), pa.array([j.hexdigest() for j in joined]), _lists(np.bincount(doc, minlength=len(counts)), found)],
            ["doc_id", "n_words", "kept_sha256", "anchors"],
        )

    return batch


def _windows(width: int):
    """doc_id, and for each window of the given stretches: two fingerprints and its place."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, places, ones, twos = [], [], [], []
        flat, ends = word_fingerprints(rows.column(1), lower=False)
        for i, (words, stretches) in enumerate(zip(np.split(flat, ends[:-1]), rows.column(2).to_pylist(), strict=True)):
            at = np.unique(np.concatenate([np.arange(s["first"], s["first"] + s["size"]) for s in stretches]))
            one, two = window_names(words, width, 1), window_names(words, width, 2)
            at = at[at < len(one)]
            ids.append(np.full(len(at), i))
            places.append(at)
            ones.append(one[at])
            twos.append(two[at])
        take = pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int64())
        cat = lambda xs, t: pa.array(np.concatenate(xs).astype(t) if xs else np.empty(0, t))
        return pa.RecordBatch.from_arrays([rows.column(0).take(take), cat(places, np.int32), pa.array(np.concatenate(ones).view(np.int64)), pa.array(np.concatenate(twos).view(np.int64))], ["doc_id", "place", "one", "two"])

    return batch


def repeats(docs: DataFrame, width: int = 50) -> tuple[DataFrame, DataFrame]:
    """(sketch, cuts) of ``docs(doc_id, text)``.

    sketch: doc_id, n_words, kept_sha256 of the uncut words, and first_id: the smallest id with the same words.
    cuts: doc_id, text, places: the first words of the windows to remove, for documents that lose some
    but aren't copies of a smaller one.

    Each step is written before the next begins, so that what a step has shuffled can go.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchored_path, windows_path, least_path = (fresh_path(spark, x) for x in ("anchors", "windows", "least"))
    anchored = materialise(map_batches(docs, _sketch(width), "doc_id bigint, n_words bigint, kept_sha256 string, anchors array<struct<name bigint, first int, size int>>"), "anchors", anchored_path)
    # Which of equal sequences is the first; only those that have a copy are kept.
    copies = anchored.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= width)).groupBy("kept_sha256").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("kept_sha256", "first_id")
    sketch = materialise(anchored.drop("anchors").join(copies, "kept_sha256", "left"), "sketch")
    known = anchored.where(F.col("doc_id").isNotNull()).select("doc_id", "anchors")
    found = known.join(sketch.where("doc_id > first_id").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.explode("anchors").alias("a")).select("doc_id", "a.*")
    shared = materialise(found.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("name"), "shared")
    release(spark)
    stretches = materialise(found.join(shared, "name").groupBy("doc_id").agg(F.collect_list(F.struct("first", "size")).alias("stretches")), "stretches")
    del found, known, anchored
    release(spark, anchored_path)
    texts = materialise(docs.join(stretches, "doc_id"), "candidates")
    release(spark)
    windows = materialise(map_batches(texts, _windows(width), "doc_id bigint, place int, one bigint, two bigint", rows=64), "windows", windows_path)
    least = materialise(windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("one", "two", "least"), "least", least_path)
    release(spark)
    gone = windows.join(least, ["one", "two"]).where("doc_id > least")
    places = materialise(gone.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "places")
    del windows, least, gone
    release(spark, windows_path, least_path)
    return sketch, texts.select("doc_id", "text").join(places, "doc_id")


def _cut(width: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        removed, kept = [], []
        for text, places in zip(raw_texts(rows.column(1)), rows.column(2).to_pylist(), strict=True):
            words = text.split()  # bytes part at just the six white characters
            change = np.zeros(len(words) + width + 1, np.int32)
            at = np.array([p for p in places if p + width <= len(words)], dtype=np.int64)
            change[at] = 1
            np.add.at(change, at + width, -1)
            stays = np.cumsum(change)[: len(words)] == 0
            removed.append(len(words) - int(stays.sum()))
            kept.append(b" ".join([w for w, k in zip(words, stays.tolist(), strict=True) if k]).decode())
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "kept"])

    return batch


def cut_texts(cuts: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_removed, kept (the words left, joined by one space) of the documents in ``cuts``."""
    return map_batches(cuts, _cut(width), "doc_id bigint, n_removed bigint, kept string", rows=64)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with ``text`` replaced by the words left where words were removed, other rows and columns untouched.

    A document that loses all its words keeps its row with an empty text.
    """
    sketch, cuts = repeats(docs, width)
    whole = sketch.where("doc_id > first_id").select("doc_id").distinct().withColumn("kept_", F.lit(""))
    part = cut_texts(cuts, width).select("doc_id", F.col("kept").alias("kept_")).dropDuplicates(["doc_id"])
    changed = whole.unionByName(part).withColumnRenamed("doc_id", "id_")
    joined = docs.join(changed, docs["doc_id"].cast("long") == changed["id_"], "left")
    return joined.select(*[F.coalesce("kept_", docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])


def digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    sketch, cuts = repeats(docs, width)
    part = cut_texts(cuts, width).select("doc_id", F.col("n_removed").alias("cut_"), F.sha2(F.col("kept").cast("binary"), 256).alias("sha_")).dropDuplicates(["doc_id"])
    copy = F.col("doc_id") > F.col("first_id")
    return sketch.join(part, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut_", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha_", "kept_sha256")).alias("kept_sha256"),
    )
