"""Connected components by contraction, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``edges(a, b)`` (bigint, in any order): root is the smallest id it reaches.

    A round maps every vertex to the least of itself and its neighbours and replaces each edge by
    that of the images. Only vertices that still have edges take part, so a component shrinks to one
    vertex in about as many rounds as the logarithm of its diameter; a chain of maps then leads each id
    to its root. Minima are pre-aggregated before the shuffle, so a hub with any number of links is no
    hot group, and the joins can be split where they are skewed. No list of neighbours is gathered.
    """
    spark = edges.sparkSession
    edges = materialise(edges.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "images")
        maps.append(to)
        moved = edges.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        edges = materialise(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "id bigint, root bigint")
    out = maps.pop()
    while maps:
        later = out.select(F.col("id").alias("to"), F.col("to").alias("then"))
        out = maps.pop().join(later, "to", "left").select("id", F.coalesce("then", "to").alias("to"))
    return out.select("id", F.col("to").alias("root"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root`` when ``links(a, b)`` are added to the components ``found(id, root)``: only their roots are worked on again."""
    root = lambda c: found.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    ends = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    moved = materialise(components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))), "moved")
    old = found.join(moved.select(F.col("id").alias("root"), F.col("root").alias("then")), "root", "left").select("id", F.coalesce("then", "root").alias("root"))
    return old.unionByName(moved.join(found.select("id"), "id", "left_anti"))
