"""A corpus pipeline of five operators; each stage's result is written and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars. Rows with a null doc_id can't be compared or looked
up by id, so only the toxicity stage can reject them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, near_duplicates, substrings, toxicity
from tessella.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts to be toxic go."""
    return toxicity.scores(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 80 per cent of their 5-word shingles in common, the smallest id stays."""
    gone = near_duplicates.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller id has too are cut; a document of which nothing is left goes."""
    cut = substrings.remove_repeats(docs.withColumn("whole", F.xxhash64("text"))).withColumn("cut", F.xxhash64("text") != F.col("whole"))
    left = cut.where(~F.col("cut") | (F.col("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold phrases of two benchmark items or more go."""
    gone = decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left, with their decoded texts'."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("substrings", without_repeats),
    ("decontamination", without_benchmarks),
    ("bpe", encoded),
]

#: A learned classifier, components and byte-pair merges aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
