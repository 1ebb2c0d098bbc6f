"""Approximate nearest neighbours by cosine: an NN-descent graph built in Spark rounds, searched greedily.

Vectors of one direction (equal to nine decimals once normalised) become one class, so that thousands of copies, scaled or
not, are one node; a class keeps its ``top + 1`` smallest ids, all that an answer can need, and they are scored one by one. Every
class starts with the best of a few random blocks. In each round the neighbours of a class, and a bounded random choice
of the classes it is a neighbour of, meet, and pairs of which one came in with the last two rounds are measured; each keeps its
``degree`` best. Neighbours of neighbours thus become neighbours. Rounds end when few neighbours are new.

A query starts from the neighbours of its own vector, or from spread entry points if it isn't a row of the
index, and in each round expands the best classes that it hasn't yet, keeping the ``beam`` best it has met.

The graph and the search measure on unit vectors with a byte for each component, which is what travels; scores are computed from
the original vectors in double. The choice of reverse neighbours is what NN-descent itself samples; every row is indexed.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or as candidates, nor
do rows with a null id or vectors of another length than the smallest valid id's; repeated rows (one id, one vector) count
once; ties, among them all vectors of one direction, go to the smaller id; with fewer candidates than asked for, all come.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, map_batches, materialise, release

DEGREE, REVERSE = 24, 24
BEAM, WIDTH, STEPS = 400, 48, 9
#: What a class can gain from one meeting in a round.
GAIN = 12
#: Rounds for which a neighbour counts as fresh: a meeting passes on GAIN pairs only, so pairs have a second chance.
FRESH = 2
#: Share of neighbours that must be new for another round.
STILL = 0.005
#: Classes of a block from which the first neighbours come, and how many blocks a class is in.
BLOCK, DEALS = 48, 3


def valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector of the rows that take part, vectors as doubles."""
    ok = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(ok)
    length = found.agg(F.min_by(F.size("vector"), F.struct("id", F.size("vector"))).alias("n")).first().n
    return found.where(F.size("vector") == (length or 0))


def _unit(rows: pa.RecordBatch) -> pa.RecordBatch:
    codes, keys = [], []
    for v in rows.column(1).to_pylist():
        x = np.array(v, dtype=np.float64)
        x = x / np.abs(x).max()
        codes.append(np.rint(x * 127).astype(np.int8).tobytes())
        keys.append(xxhash.xxh3_128_digest((np.round(x / np.linalg.norm(x), 9) + 0.0).tobytes()))
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(codes, pa.binary()), pa.array(keys, pa.binary()), rows.column(1)], ["id", "vec", "key", "vector"])


def _matrix(values: list[bytes]) -> np.ndarray:
    """Unit vectors of codes."""
    x = np.frombuffer(b"".join(values), np.int8).reshape(len(values), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` largest, ties to smaller ids."""
    return np.lexsort((ids, -sims))[:most]


def _pairs_within(batch: pa.RecordBatch, most: int) -> pa.RecordBatch:
    """Of each group's members (id, vec, least, fresh): what each gains from the others, where one of the two is fresh: id, other, sim."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for group in batch.column(0).to_pylist():
        unique = {m["id"]: m for m in sorted(group, key=lambda m: m["fresh"])}  # fresh if so in any of its places
        ids = np.array(list(unique), dtype=np.int64)
        if len(ids) < 2:
            continue
        v = _matrix([m["vec"] for m in unique.values()])
        sims = v @ v.T
        np.fill_diagonal(sims, -2)
        new = np.array([m["fresh"] for m in unique.values()]) > 0
        sims[~new[:, None] & ~new] = -2  # measured before
        least = np.array([m["least"] for m in unique.values()], dtype=np.float32)
        k = min(most, len(ids) - 1)
        cols = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(ids)), k)
        cols = cols.ravel()
        good = sims[rows, cols] > least[rows]
        out.append((ids[rows[good]], ids[cols[good]], sims[rows[good], cols[good]]))
    cat = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, t) for t in (np.int64, np.int64, np.float32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cat], ["id", "other", "sim"])


def _keep(found: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """id, vec, near array<struct<sim, id, fresh>>, least: the ``degree`` best of ``found(id, other, sim, fresh)`` for each node."""
    # A pair can be met in several groups, with sums that differ in the last place. A class is met in a bounded number of groups.
    once = found.repartition("id").groupBy("id", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    best = once.groupBy("id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("sim", (-F.col("other")).alias("m"), "fresh")))), 1, degree).alias("b"))
    near = F.transform("b", lambda x: F.struct(x["sim"].alias("sim"), (-x["m"]).alias("id"), x["fresh"].alias("fresh")))
    out = nodes.join(best, "id", "left").select("id", "vec", F.coalesce(near, F.array().cast("array<struct<sim:float,id:bigint,fresh:int>>")).alias("near"))
    return out.withColumn("least", F.when(F.size("near") >= degree, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0).cast("float")))


def build_graph(nodes: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, rounds: int | None = None) -> DataFrame:
    """id, vec, near, least of ``nodes(id, vec)``: the neighbour graph after at most ``rounds`` rounds, by default as many as its size takes to mix."""
    spark = nodes.sparkSession
    n = nodes.count()
    blocks = max(1, n // BLOCK)
    rounds = max(5, round(0.6 * math.log2(n + 1))) if rounds is None else rounds
    member = F.struct("id", "vec", F.lit(-2.0).cast("float").alias("least"), F.lit(FRESH).alias("fresh"))
    # A block holds about BLOCK classes whatever the data: it is a hash of the id. Several ways of dealing mix the blocks.
    way = F.explode(F.array(*[F.xxhash64(F.pmod(F.xxhash64("id", F.lit(w)), F.lit(blocks)), F.lit(w)) for w in range(DEALS)])).alias("block")
    dealt = nodes.select(way, member.alias("m")).groupBy("block").agg(F.collect_list("m").alias("members")).select("members")
    first = map_batches(dealt, lambda b: _pairs_within(b, degree // 2), "id bigint, other bigint, sim float", rows=64)
    path = fresh_path(spark, "graph")
    graph = materialise(_keep(first.withColumn("fresh", F.lit(FRESH)), nodes, degree), "graph", path)
    for r in range(rounds):
        fresh = graph.agg(F.sum(F.size(F.filter("near", lambda x: x["fresh"] > 0)))).first()[0] or 0
        if fresh < STILL * n * degree:
            break
        edges = graph.select("id", "vec", "least", F.explode("near").alias("n")).select("id", "vec", "least", F.col("n.id").alias("other"), F.col("n.sim").alias("sim"), F.col("n.fresh").alias("fresh"))
        # Those whose neighbour a class is: a random few, fresh ones first, cut before the shuffle where they lie.
        order = Window.partitionBy("other").orderBy(F.desc("fresh"), F.xxhash64("id", F.lit(r)), "id")
        links = edges.select("id", "other", "fresh").withColumn("k", F.row_number().over(order)).where(F.col("k") <= reverse)
        met = links.select(F.col("other").alias("at"), "id", "fresh").unionByName(edges.select(F.col("id").alias("at"), F.col("other").alias("id"), "fresh")).unionByName(graph.select(F.col("id").alias("at"), "id", F.lit(0).alias("fresh")))
        # Ids meet first: only classes that something new has reached need vectors.
        lists = met.groupBy("at").agg(F.max("fresh").alias("any"), F.collect_list(F.struct("id", "fresh")).alias("m")).where("any > 0").select("at", F.explode("m").alias("m")).select("at", "m.id", "m.fresh")
        members = lists.join(graph.select("id", "vec", "least"), "id").groupBy("at").agg(F.collect_list(F.struct("id", "vec", "least", "fresh")).alias("members")).select("members")
        gained = map_batches(members, lambda b: _pairs_within(b, GAIN), "id bigint, other bigint, sim float", rows=256).withColumn("fresh", F.lit(FRESH))
        old = edges.select("id", "other", "sim", F.greatest(F.col("fresh") - 1, F.lit(0)).alias("fresh"))
        last, path = path, fresh_path(spark, "graph")
        graph = materialise(_keep(gained.unionByName(old), nodes, degree), "graph", path)
        del edges, links, met, lists, members, gained, old
        release(spark, last)
    return graph


def _start(beam: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids = [[n["id"] for n in near] for near in rows.column(2).to_pylist()]
        sims = [[n["sim"] for n in near] for near in rows.column(2).to_pylist()]
        own = rows.column(0).to_pylist()
        beams = [[o, *i] for o, i in zip(own, ids, strict=True)]
        scores = [[1.0, *s] for s in sims]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(beams, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float32())), pa.array([[o] for o in own], pa.list_(pa.int64())), pa.array([i[:WIDTH] for i in ids], pa.list_(pa.int64()))],
            ["q", "vec", "beam", "sims", "done", "next"],
        )

    return batch


STATE = "q bigint, vec binary, beam array<bigint>, sims array<float>, done array<bigint>, next array<bigint>"


def _expand(beam: int, width: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Join what the expanded classes' neighbours are to a query's beam."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        beams, scores, dones, nexts = [], [], [], []
        for vec, old, sims, done, step, found in zip(*(rows.column(k).to_pylist() for k in range(1, 7)), strict=True):
            known = set(old)
            new = {n["id"]: n["vec"] for part in found or [] for n in part if n["id"] not in known}
            ids = np.array([*old, *new], dtype=np.int64)
            all_sims = np.array(sims, dtype=np.float32)
            if new:
                all_sims = np.concatenate((all_sims, _matrix(list(new.values())) @ _matrix([vec])[0]))
            best = _best(ids, all_sims, beam)
            seen = {*done, *step}
            beams.append(ids[best].tolist())
            scores.append(all_sims[best].tolist())
            dones.append(sorted(seen))
            nexts.append([i for i in beams[-1] if i not in seen][:width])
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), *(pa.array(x, pa.list_(k)) for x, k in zip((beams, scores, dones, nexts), (pa.int64(), pa.float32(), pa.int64(), pa.int64()), strict=True))], ["q", "vec", "beam", "sims", "done", "next"]
        )

    return batch


def search_graph(graph: DataFrame, starts: DataFrame, beam: int = BEAM, width: int = WIDTH, steps: int = STEPS) -> DataFrame:
    """q, beam of ``starts(id, vec, near)``: the classes that a greedy search from each query's own neighbours keeps."""
    edges = graph.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"))
    with_vectors = edges.join(graph.select(F.col("id").alias("other"), "vec"), "other").groupBy("id").agg(F.collect_list(F.struct(F.col("other").alias("id"), "vec")).alias("found"))
    lists = materialise(with_vectors, "lists")
    state = materialise(map_batches(starts.select("id", "vec", "near"), _start(beam), STATE), "beams")
    for _ in range(steps):
        step = state.select("q", F.explode("next").alias("id")).join(lists, "id").groupBy("q").agg(F.collect_list("found").alias("found"))
        state = materialise(map_batches(state.join(step, "q", "left"), _expand(beam, width), STATE, rows=64), "beams")
    return state.select("q", "beam")


def nearest(rows: DataFrame, is_query: F.Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row for which ``is_query`` (over ``id``) holds."""
    spark = rows.sparkSession
    unit = materialise(map_batches(valid(rows, id_col, vector_col), _unit, "id bigint, vec binary, key binary, vector array<double>", rows=2000), "unit")
    # The smallest ids of one direction; partitions cut them to top + 1 before the shuffle.
    order = Window.partitionBy("key").orderBy("id")
    once = unit.select("key", "id").dropDuplicates(["id"])
    ranked = once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
    groups = materialise(ranked.groupBy("key").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "groups")
    nodes = materialise(unit.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "vec").dropDuplicates(["id"]), "nodes")
    graph = build_graph(nodes)
    # Queries of one class are searched once.
    asked = unit.where(is_query).select(F.col("id").alias("query_id"), "key", F.col("vector").alias("mine")).dropDuplicates(["query_id"])
    asked = materialise(asked.join(groups.select("key", "rep"), "key").drop("key"), "asked")
    beams = search_graph(graph, graph.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    release(spark)
    # One query of each class ranks the classes met, on the original vectors; then their smallest members are scored for every query.
    first = asked.groupBy("rep").agg(F.min_by("mine", "query_id").alias("mine"))
    met = beams.select(F.col("q").alias("rep"), F.explode("beam").alias("other")).join(unit.select(F.col("id").alias("other"), F.col("vector").alias("theirs")).dropDuplicates(["other"]), "other").join(first, "rep")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.array(batch.column(k).to_pylist(), dtype=np.float64) for k in (2, 3))
        a, b = (x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x for x in (a, b))
        exact = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))) if len(a) else np.empty(0)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact)], ["x", "y", "score"])

    scored = map_batches(met.select("rep", "other", "mine", "theirs"), score, "x bigint, y bigint, score double", rows=2000)
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))).where(F.col("k") <= top + 1).select(F.col("x").alias("rep"), F.col("y").alias("other"))
    members = best.join(groups.select(F.col("rep").alias("other"), F.explode("ids").alias("vec_id")), "other").select("rep", "vec_id")
    # As many members of each class as an answer can need: at most (top + 1) ** 2 for a query.
    pairs = asked.join(members, "rep").where("vec_id != query_id").join(unit.select(F.col("id").alias("vec_id"), F.col("vector").alias("theirs")).dropDuplicates(["vec_id"]), "vec_id")
    flat = map_batches(pairs.select("query_id", "vec_id", "mine", "theirs"), score, "x bigint, y bigint, score double", rows=2000).select(F.col("x").alias("query_id"), F.col("y").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
