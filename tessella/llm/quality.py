"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log-odds over buckets of simple statistics of its whole text. A site's
share of good documents is estimated at two levels: a host's posterior is a beta mean shrunk to the global share, a
path's is shrunk to its host's; how strongly follows from the spread between groups by the method of moments, so
sparse hosts and paths fall back to what stands above them. Score: the path's posterior log-odds plus the evidence.

Counts by host and path are grouped aggregations, pre-aggregated before their shuffle. Joins with documents carry ids and a
number only, never texts, and can be split where a host is hot.

Edge cases: null and empty texts have the statistics of no words; null hosts and paths form groups of their own; rows
with one id are scored one by one; labels other than 0 and 1 are ignored; without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, materialise, texts

#: Statistics of a text that speak for or against it; each is a share, or a logarithm, cut into BUCKETS.
STATISTICS = ("words", "distinct", "length", "upper", "marks", "digits", "lines")
BUCKETS = 24
#: Statistics lean on each other: their log-odds are damped by this power of their number.
DAMPING = 0.5


def statistics(text: str) -> list[int]:
    """The bucket of each statistic of a whole text."""
    words, n = text.split(), max(1, len(text))
    lines = [line for line in text.split("\n") if line.strip()]
    letters = sum(map(len, words))
    plain = text.translate(_DROPPED)
    shares = (
        math.log2(1 + len(words)) / 20,
        len(set(words)) / max(1, len(words)),
        letters / max(1, len(words)) / 16,
        sum(map(str.isupper, words)) / max(1, len(words)),
        5 * (len(text) - len(plain) - text.count(" ") - text.count("\n")) / n,
        5 * sum(text.count(d) for d in "0123456789") / n,
        len(set(lines)) / max(1, len(lines)),
    )
    return [min(BUCKETS - 1, int(s * BUCKETS)) for s in shares]


#: ASCII signs and white space, dropped to count what is left.
_DROPPED = {c: None for c in range(128) if not chr(c).isalnum()}


def _measured(rows: pa.RecordBatch) -> pa.RecordBatch:
    found = pa.array([statistics(t) for t in texts(rows.column(3))], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([*rows.columns[:3], found], ["doc_id", "host", "path", "buckets"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def prior_strength(mean: Column) -> Column:
    """Pseudo-counts of a beta prior from the spread of groups (n, good) around ``mean``: moments, between 1 and 10,000."""
    spread = F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) ** 2)
    k, total, squares = F.count("*"), F.sum("n"), F.sum(F.col("n") ** 2)
    var = F.greatest((spread - (k - 1) * F.max(mean * (1 - mean))) / F.greatest(total - squares / total, F.lit(1e-9)), F.lit(1e-9))
    return F.coalesce(F.least(F.greatest(F.max(mean * (1 - mean)) / var - 1, F.lit(1.0)), F.lit(10_000.0)), F.lit(10_000.0))


def scores(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; held-out labels are never seen.

    ``host`` and ``path`` are expressions over ``docs``; by default its source, and source with language.
    """
    host = F.coalesce(host if host is not None else F.col("source"), F.lit(""))
    path = F.concat_ws("/", host, F.coalesce(path if path is not None else F.col("lang"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), "text")
    measured = materialise(map_batches(rows, _measured, "doc_id bigint, host string, path string, buckets array<int>"), "measured")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where(~held_out() & F.col("good").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"))
    seen = materialise(measured.join(known, "doc_id"), "seen")
    total = seen.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    if not total.n or total.good in (0, total.n):
        return measured.select("doc_id", held_out().alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    share = total.good / total.n

    # Evidence: at most len(STATISTICS) * BUCKETS rows.
    cells = seen.select("good", F.posexplode("buckets").alias("s", "b")).groupBy("s", "b").agg(F.sum("good").alias("g"), F.count("*").alias("n")).collect()
    odds = [[0.0] * BUCKETS for _ in STATISTICS]
    for c in cells:
        odds[c.s][c.b] = math.log((c.g + 1) / (total.good + BUCKETS)) - math.log((c.n - c.g + 1) / (total.n - total.good + BUCKETS))
    table = F.array(*[F.array(*map(F.lit, o)) for o in odds])
    gains = F.transform("buckets", lambda b, s: F.get(F.get(table, s), b))
    evidence = F.aggregate(gains, F.lit(0.0), lambda a, g: a + g) / len(STATISTICS) ** DAMPING

    # Hosts to the global share, paths to their hosts.
    paths = seen.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    m = hosts.agg(prior_strength(F.lit(share)).alias("m")).first().m
    hosts = hosts.select("host", ((F.col("good") + m * share) / (F.col("n") + m)).alias("host_p"))
    within = paths.join(hosts, "host")
    k = within.agg(prior_strength(F.col("host_p")).alias("m")).first().m
    posts = within.select("path", ((F.col("good") + k * F.col("host_p")) / (F.col("n") + k)).alias("path_p"))
    joined = measured.join(hosts, "host", "left").join(posts, "path", "left")
    p = F.coalesce("path_p", "host_p", F.lit(share))
    score = 1 / (1 + F.exp(-(F.ln(p / (1 - p)) + evidence)))
    return joined.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
