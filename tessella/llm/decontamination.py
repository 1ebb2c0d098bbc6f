"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index is partitioned by document: a stored table gives each document's terms by position, and its
postings (term, document, position) are read from it by ``postings``. A test phrase is found by intersecting
its terms' lists, each moved back by the term's offset in the phrase, from the rarest term on: postings of
the rarest give possible starts, and a start stays only if the second rarest stands at its offset there, and
then all others. As lists of one document lie together, the intersections need no exchange; only the few
postings of rarest terms are ever joined with the phrases. Rarity is counted over the whole index.

``near`` gives proximity matches: all terms of a phrase, each as often as in it, in one stretch of ``span`` words, in any order.

The phrases' side of the join is broadcast only if it was counted to have at most ``BROADCAST_ROWS`` rows; otherwise
both sides are dealt by term.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Edge cases: null and empty texts have no
words; an item without words has no phrase; equal phrases of several items count for each; rows with one id must
hold one text and are returned each; a null id takes part in nothing and is returned clean.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise, release

BROADCAST_ROWS = 200_000
#: What parts words: all of ASCII but digits and letters (capitals are lowered first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: str) -> F.Column:
    """The words of a text column in order; an empty array if there are none."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    # Only the first and the last piece can be empty.
    return F.filter(F.split(low, GAP, -1), lambda w: w != "")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: doc_id, terms by position."""
    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), terms(text_col).alias("terms")), "index")


def postings(index: DataFrame) -> DataFrame:
    """doc_id, terms, pos (from 0), term: one row for each place. Narrow it by a join on term at once."""
    return index.where("doc_id is not null").select("doc_id", "terms", F.posexplode("terms").alias("pos", "term"))


def phrases(items: DataFrame, width: int = 8) -> DataFrame:
    """item_id, phrase: the windows of ``width`` words of each item; all words of an item that has fewer, but some."""
    found = items.select(F.col("item_id"), terms("text").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return found.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("phrase")).distinct()


def _bounded(small: DataFrame, large: DataFrame, on: str) -> DataFrame:
    return large.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, on)


def ranked(distinct: DataFrame, index: DataFrame) -> DataFrame:
    """phrase, term, first, second, size: the rarest term, and the offsets (from 0) of the rarest and second rarest."""
    vocabulary = materialise(distinct.select(F.explode("phrase").alias("term")).distinct(), "vocabulary")
    counts = _bounded(vocabulary, postings(index).select("term"), "term").groupBy("term").agg(F.count("*").alias("n"))
    places = distinct.select("phrase", F.posexplode("phrase").alias("at", "term")).join(counts, "term", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term")))
    by_rarity = places.groupBy("phrase").agg(order.alias("o")).where(F.col("o")[0]["n"] > 0)  # else some term occurs nowhere
    second = F.coalesce(F.try_element_at("o", F.lit(2))["at"], F.col("o")[0]["at"])
    return materialise(by_rarity.select("phrase", F.col("o")[0]["term"].alias("term"), F.col("o")[0]["at"].alias("first"), second.alias("second"), F.size("phrase").alias("size")), "ranked")


def occurrences(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """doc_id, start, size, phrase of every exact occurrence of the ``ranked`` phrases."""
    starts = _bounded(rarest, postings(index), "term").withColumn("start", F.col("pos") - F.col("first"))
    inside = starts.where("start >= 0 and start + size <= size(terms)")
    both = inside.where(F.get("terms", F.col("start") + F.col("second")) == F.get("phrase", F.col("second")))
    return both.where(F.slice("terms", F.greatest(F.col("start") + 1, F.lit(1)), F.col("size")) == F.col("phrase")).select("doc_id", "start", "size", "phrase")


def near(index: DataFrame, rarest: DataFrame, span: int) -> DataFrame:
    """doc_id, pos, phrase: places of a rarest term in a stretch of ``span`` words that holds each term as often as its phrase does."""
    needs = F.transform(F.array_distinct("phrase"), lambda t: F.struct(t.alias("term"), F.size(F.filter("phrase", lambda x: x == t)).alias("n")))
    low = F.greatest(F.col("pos") - span + 1, F.lit(0))
    around = _bounded(rarest.withColumn("needs", needs), postings(index), "term").withColumn("low", low).withColumn("near", F.slice("terms", F.col("low") + 1, F.col("pos") - F.col("low") + span))
    some = around.where(F.forall("phrase", lambda t: F.array_contains("near", t)))

    def holds(start: F.Column) -> F.Column:
        stretch = F.slice("near", start + 1, span)
        return F.forall("needs", lambda need: F.size(F.filter(stretch, lambda x: x == need["term"])) >= need["n"])

    return some.where(F.exists(F.sequence(F.lit(0), F.col("pos") - F.col("low")), holds)).select("doc_id", "pos", "phrase")


def proximity(docs: DataFrame, items: DataFrame, width: int = 8, span: int = 12) -> DataFrame:
    """doc_id, n_near of every row of ``docs(doc_id, text)``: items with a phrase whose words stand within ``span`` words."""
    index = build_index(docs)
    of_items = materialise(phrases(items, width), "phrases")
    found = near(index, ranked(of_items.select("phrase").distinct(), index), span).select("doc_id", "phrase").distinct()
    counts = found.join(of_items, "phrase").select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    return index.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_near"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 8, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs(doc_id, text)``.

    n_hit: words inside an occurrence of any item's phrase; n_items: items with an occurring phrase; items_sha256: of
    their ids, sorted as strings and joined by commas; contaminated: at least ``least_items`` items.
    """
    index = build_index(docs)
    of_items = materialise(phrases(items, width), "phrases")
    found = materialise(occurrences(index, ranked(of_items.select("phrase").distinct(), index)), "occurrences")
    # Words covered by overlapping stretches: each stretch adds what lies beyond all before it.
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    stretches = found.groupBy("doc_id", "start").agg((F.col("start") + F.max("size")).alias("stop"))
    covered = stretches.withColumn("past", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = covered.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "past"))).alias("hit"))
    # Phrases of one document are made distinct before their items are looked up.
    pairs = found.select("doc_id", "phrase").distinct().join(of_items, "phrase").select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    lists = pairs.groupBy("doc_id").agg(F.count("*").alias("items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("sha"))
    marked = hits.join(lists, "doc_id")
    release(docs.sparkSession)
    n = F.coalesce("items", F.lit(0)).cast("long")
    return index.select("doc_id", F.size("terms").cast("long").alias("n_words")).join(marked, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), n.alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n >= least_items).alias("contaminated")
    )
