"""Near-duplicate documents by a Chosen Path similarity join over minwise tokens.

A document's set holds fingerprints of its word shingles. Documents with equal sets become one class.
Each class is reduced to minwise tokens, of which two classes share a fraction close to their similarity.
Independent trees branch on them: a node stands for a path of chosen coordinates with their tokens, and
holds the classes that have them all. Nodes of at most ``LIMIT`` classes are compared exhaustively, on a byte of
each token; larger ones branch again on coordinates that their path picks.

Only components are wanted, so pairs inside one component need no comparison, and no list of pairs is ever made:

A. In each node every class is offered the smallest id that it resembles; each class keeps one such offer, which is
   confirmed on the full sets. Then, in at most ``ROUNDS`` rounds, every class of a node with several components is offered
   the most alike class of another one, so that what belongs together has mostly met before step B. Large nodes are dealt into
   parts for this, others each round.
B. Nodes that still hold several components are compared across them. A large node of one main component and few others
   is dealt into parts of the main one, each with all others; a large node of many components branches again, up to
   ``DEPTH`` tokens, as long as that leaves less to compare; what doesn't shrink is compared block against block. Classes that have a partner
   whose sketch is close enough are named, at most once for each node.
C. The named classes' full sets meet in their nodes, where pairs across components are confirmed with integers, until
   the components that a node joins are one. Only the links that join components leave a node.

A pair is compared in the first small root node that it shares. A pair at the threshold 0.8 shares fewer than two of the
ten root nodes with probability 4e-6, loses all paths of branching nodes with probability 1e-6, and falls below
``SLACK`` on 256 tokens with probability 3e-5.

Edge cases: null, empty and blank texts have an empty set and link with nothing; a text of fewer words
than a shingle has one shingle, all its words; equal rows fall into one class; rows with one id count as one
document and must hold one text, each is returned; a row with a null id is returned unlinked, with a null
component, and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, materialise, mix64, release
from tessella.llm.components import components, merged
from tessella.llm.words import U, window_names, word_fingerprints

#: Minwise tokens of a class; a byte of each is compared, the first PATHS branch.
TOKENS, PATHS = 256, 32
TREES = 5
#: Coordinates that a node picks for its children.
BRANCH = 2
ROOTS = TREES * BRANCH
#: Classes that one task compares with each other, and bytes of full sets.
LIMIT, LIMIT_BYTES = 1000, 32 << 20
#: Tokens of the longest path.
DEPTH = 6
#: Rounds in which components are offered their most alike neighbours.
ROUNDS = 3
#: A node whose children would hold more than this many times its classes is compared block against block at once.
DENSE = 1.2
#: How far below the threshold the share of equal tokens may fall before a pair isn't confirmed.
SLACK = 0.10
_factors = mix64(np.arange(1, TOKENS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row."""
    flat, ends = word_fingerprints(column, lower=True)
    for words in np.split(flat, ends[:-1]):
        if len(words) >= width:
            yield np.unique(window_names(words, width, 0))
        else:
            yield window_names(words, len(words), 0) if len(words) else words


def minwise(shingles: np.ndarray) -> np.ndarray:
    """``TOKENS`` minima, each under its own multiplicative order, cut to 32 bits."""
    least = np.full(TOKENS, ~U(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            np.minimum(least, (shingles[at : at + 1024, None] * _factors).min(axis=0), out=least)
    return (mix64(least) >> U(32)).astype(np.uint32)


def _summary(width: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, paths, sketches = [], [], [], []
        for s in shingle_sets(rows.column(1), width):
            tokens = minwise(s) if len(s) else np.zeros(TOKENS, np.uint32)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            paths.append(tokens[:PATHS].view(np.int32))
            sketches.append(tokens.astype(np.uint8).tobytes() if len(s) else None)
        ends = pa.array(np.arange(0, PATHS * len(sizes) + 1, PATHS, dtype=np.int32))
        tokens = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(paths) if paths else np.empty(0, np.int32)))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), tokens, pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_key", "tokens", "sketch"])

    return batch


def _sets(width: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in shingle_sets(rows.column(1), width)], pa.binary())], ["id", "shingles"])

    return batch


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)) or not len(p):
        return False
    at = np.searchsorted(q, p)
    both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _confirm(percent: int):
    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        good = [_similar(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(rows.column(2), rows.column(3), strict=True)]
        return rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return batch


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough: 100 * intersection >= percent * union."""
    joined = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return materialise(map_batches(joined.select("a", "b", "x", "y"), _confirm(percent), "a bigint, b bigint"), "links")


def _child(path: F.Column, k: int) -> F.Column:
    """The coordinate that is a path's k-th choice, beyond those of the roots; the choices of one path differ."""
    return (F.pmod(F.xxhash64(path, F.lit(0)) + k, F.lit(PATHS - ROOTS)) + ROOTS).cast("int")


def branched(members: DataFrame) -> DataFrame:
    """Children of the nodes in ``members(node, id, tokens)``, with the same other columns."""
    kids = F.explode(F.array(*[F.xxhash64("node", _child(F.col("node"), k), F.element_at("tokens", _child(F.col("node"), k) + 1)) for k in range(BRANCH)]))
    return members.select(kids.alias("kid"), *[c for c in members.columns if c != "node"]).withColumnRenamed("kid", "node")


def _alike(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Shares of equal tokens, less what bytes of different tokens agree by chance."""
    return ((sketches == one).mean(axis=-1) - 1 / 256) * (256 / 255)


def leaders(ids: np.ndarray, sketches: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller class that it resembles, class), each class with the smallest that isn't led itself."""
    order = np.argsort(ids)
    while len(order) > 1:
        like = _alike(sketches[order[1:]], sketches[order[0]]) >= share
        if like.any():
            yield np.full(int(like.sum()), ids[order[0]]), ids[order[1:][like]]
        order = order[1:][~like]


class Cell:
    """The classes that one task compares: all with all, or two sides, or two blocks, with each other."""

    def __init__(self, rows: pa.Table) -> None:
        one = {i: k for k, i in enumerate(rows["id"].to_pylist())}  # an id once
        rows = rows.take(pa.array(list(one.values()), pa.int64())) if len(one) < len(rows) else rows
        self.rows = rows
        self.id, self.comp, self.side, self.block = (rows[c].to_numpy() for c in ("id", "comp", "side", "block"))
        self.roots = np.array(rows["roots"].to_pylist(), np.int64).reshape(len(rows), ROOTS)
        self.sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
        self.at = int(rows["at"][0].as_py())

    def partners(self, share: float) -> Iterator[tuple[int, np.ndarray]]:
        """Positions, and those of classes in other components that agree enough with it; each pair once, and not if an earlier root has it."""
        values, counts = np.unique(self.comp, return_counts=True)
        if len(values) < 2:
            return
        # The largest component's classes are only compared with others, not among themselves.
        main = self.comp == values[counts.argmax()]
        place = np.arange(len(self.id))
        for i in np.flatnonzero(~main):
            good = (self.comp != self.comp[i]) & (main | (place > i))
            if self.side[i]:
                good &= self.side != self.side[i]
            if self.block.any():
                good &= self.block != self.block[i]
            far = np.flatnonzero(good)
            mine = self.roots[i, : self.at]
            far = far[~((self.roots[far, : self.at] == mine) & (mine != 0)).any(axis=1)]
            if len(far):
                far = far[_alike(self.sketch[far], self.sketch[i]) >= share]
            if len(far):
                yield int(i), far


def _offers(share: float):
    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        ids, sketches = rows["id"].to_numpy(), np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
        found = list(leaders(ids, sketches, share))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"]) if found else None

    return cell


def _nearest(share: float):
    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        ids, comps = rows["id"].to_numpy(), rows["comp"].to_numpy()
        if (comps == comps[0]).all():
            return None
        sketches, out = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS), []
        for i in range(len(ids)):
            far = np.flatnonzero(comps != comps[i])
            like = _alike(sketches[far], sketches[i])
            best = int(like.argmax())
            if like[best] >= share:
                out.append((int(ids[far[best]]), int(ids[i]), float(like[best])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "like"]) if out else None

    return cell


def _named(share: float):
    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        met = Cell(rows)
        hit = np.zeros(len(met.id), bool)
        for i, far in met.partners(share):
            hit[i] = True
            hit[far] = True
        return met.rows.select(["cell", "id", "comp", "side", "at"]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else None

    return cell


def _linked(share: float, percent: int):
    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        met, root, links = Cell(rows), {}, []
        sets = [np.frombuffer(x.as_buffer(), U) for x in met.rows["shingles"]]

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        for i, far in met.partners(share):
            for j in far:
                x, y = top(int(met.comp[i])), top(int(met.comp[j]))
                if x != y and _similar(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    links.append(sorted((int(met.id[i]), int(met.id[j]))))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"]) if links else None

    return cell


def by_cell(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each cell's rows, one cell at a time, wherever Arrow's batches end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cell = table["cell"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y - x > 1 and (out := function(table.slice(x, y - x))) is not None:
                    yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            cell = batch.column(0).to_numpy()
            if len(held) > 1 and held[-2].column(0)[-1].as_py() == cell[0] and cell[0] == cell[-1]:
                continue
            table = pa.Table.from_batches(held)
            cell = table["cell"].to_numpy()
            other = np.flatnonzero(cell != cell[-1])
            if len(other):
                yield from flush(table.slice(0, int(other[-1]) + 1))
                held = table.slice(int(other[-1]) + 1).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _across(active: DataFrame, comps: DataFrame, limit: int, depth: int) -> DataFrame:
    """cell, id, comp, side, at: where classes of several components meet, in cells of a bounded size."""
    rows = _with_components(active.select("id", "tokens", "nodes"), comps).select("id", "comp", "tokens", F.explode("nodes").alias("x")).select("id", "comp", "tokens", "x.*")
    columns = ("cell", "id", "comp", "side", "at")
    whole = lambda d, at: d.select(F.col("node").alias("cell"), "id", "comp", F.lit(0).alias("side"), at.alias("at"))
    mixed = lambda d: d.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("p"), F.max("comp").alias("q")).where("p < q").select("node", "n")
    few = rows.where(F.col("n") <= limit).drop("n")
    out = whole(few.join(mixed(few), "node", "left_semi"), F.col("c"))
    big, end, crowded = rows.where(F.col("n") > limit).drop("n", "c"), F.lit(ROOTS), []
    for level in range(depth):
        if big.isEmpty():
            break
        big = materialise(big, "large")
        sizes = big.groupBy("node", "comp").agg(F.count("*").alias("k"))
        nodes = sizes.groupBy("node").agg(F.sum("k").alias("n"), F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
        nodes = materialise(nodes.select("node", "n", F.col("m.comp").alias("main"), (F.col("n") - F.col("m.k")).alias("others")), "nodes")
        mine = big.join(nodes, "node")
        out = out.unionByName(whole(mine.where(F.col("n") <= limit), end))
        # Few others: the main component is dealt into parts, and each of them meets all others.
        parts = F.ceil(F.col("n") / limit).cast("int")
        dealt = mine.where((F.col("n") > limit) & (F.col("others") <= limit // 2)).withColumn("own", F.col("comp") == F.col("main"))
        part = F.explode(F.when(F.col("own"), F.array(F.pmod(F.xxhash64("id"), parts).cast("int"))).otherwise(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.withColumn("part", part).withColumn("side", F.when(F.col("part") == 0, 0).when(F.col("own"), 2).otherwise(1))
        out = out.unionByName(dealt.withColumn("cell", F.xxhash64("node", "part")).withColumn("at", end).select(*columns))
        many = materialise(mine.where((F.col("n") > limit) & (F.col("others") > limit // 2)).select("node", "id", "comp", "tokens", "n"), "many")
        kids = branched(many.drop("n").withColumn("parent", F.col("node")))
        kept = kids.groupBy("parent", "node").agg(F.count("*").alias("k"), F.min("comp").alias("p"), F.max("comp").alias("q")).where("p < q").groupBy(F.col("parent").alias("node")).agg(F.sum("k").alias("kept"))
        dense = materialise(many.groupBy("node").agg(F.max("n").alias("n")).join(kept, "node").where(F.lit(level == depth - 1) | (F.col("kept") > DENSE * F.col("n"))).select("node"), "dense")
        crowded.append(many.join(dense, "node", "left_semi"))
        big = kids.join(dense.withColumnRenamed("node", "parent"), "parent", "left_anti").drop("parent")
    for rows in crowded:
        blocks = F.ceil(F.col("n") / limit).cast("int")
        mine = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
        out = out.unionByName(mine.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "id", "comp", side.alias("side"), end.alias("at")))
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text)``.

    Documents are linked when their sets of ``width``-word shingles have at least ``percent`` per cent of their
    union in common; component_id is the smallest id reachable over links, kept whether that is the row's own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summary = materialise(map_batches(docs, _summary(width), "doc_id bigint, n_shingles bigint, set_key binary, tokens array<int>, sketch binary"), "summary")
    known = summary.where("doc_id is not null and set_key is not null")
    classes = materialise(known.groupBy("set_key").agg(F.min_by(F.struct("tokens", "sketch", "n_shingles"), "doc_id").alias("s"), F.min("doc_id").alias("id")).select("set_key", "id", "s.*"), "classes")

    # First level: each tree's root branches on its own coordinates. Only classes that meet others in two nodes can be linked.
    roots = F.array(*[F.xxhash64(F.lit(c), F.col("tokens")[c]) for c in range(ROOTS)])
    first = classes.select("id", F.posexplode(roots).alias("c", "node"))
    sizes = first.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    met = first.join(sizes, "node").groupBy("id").agg(F.collect_list(F.struct("c", "node", "n")).alias("nodes")).where(F.size("nodes") >= 2)
    small = F.aggregate("nodes", F.array_repeat(F.lit(0).cast("long"), ROOTS), lambda a, x: F.when(x["n"] > limit, a).otherwise(F.transform(a, lambda v, k: F.when(k == x["c"], x["node"]).otherwise(v))))
    active = materialise(met.join(classes.select("id", "tokens", "sketch", "n_shingles"), "id").withColumn("roots", small), "active")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(active.select("id"), "id", "left_semi")
    sets = materialise(map_batches(texts, _sets(width), "id bigint, shingles binary").dropDuplicates(["id"]), "sets")
    release(spark)
    nodes = active.select("id", "sketch", F.explode("nodes").alias("x")).select("id", "sketch", "x.node", "x.n")
    cell = lambda salt: F.when(F.col("n") <= limit, F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col("n") / limit)))).alias("cell")
    offers = by_cell(nodes.select(cell(0), "id", "sketch"), _offers(percent / 100 + 0.02), "a bigint, b bigint").groupBy("b").agg(F.min("a").alias("a"))
    comps = materialise(components(confirmed(offers, sets, percent)), "components")
    release(spark)
    for salt in range(1, ROUNDS + 1):
        rows = _with_components(nodes, comps)
        mixed = rows.groupBy("node").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p < q").select("node")
        found = by_cell(rows.join(mixed, "node", "left_semi").select(cell(salt), "id", "comp", "sketch"), _nearest(percent / 100 - 0.02), "a bigint, b bigint, like double")
        links = confirmed(found.groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a")), sets, percent)
        if links.isEmpty():
            break
        comps = materialise(merged(comps, links), "components")
        release(spark)

    floor = percent / 100 - SLACK
    detail = active.select("id", "sketch", "roots", "n_shingles")
    cells = _across(active, comps, limit, depth).withColumn("block", F.lit(0))
    named = materialise(by_cell(cells.join(detail.drop("n_shingles"), "id").select("cell", "id", "comp", "side", "at", "block", "sketch", "roots"), _named(floor), "cell bigint, id bigint, comp bigint, side int, at int"), "named")
    release(spark)
    if not named.isEmpty():
        # Cells whose full sets are too large for a task are dealt into blocks.
        weighed = named.join(detail, "id")
        heavy = weighed.groupBy("cell").agg(F.ceil(F.sum("n_shingles") * 8 / LIMIT_BYTES).cast("int").alias("blocks"))
        mine = weighed.join(heavy, "cell").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        block = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        cell = F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
        dealt = mine.select(cell.alias("cell"), "id", "comp", "side", "at", block.alias("block"), "sketch", "roots").join(sets, "id").select("cell", "id", "comp", "side", "at", "block", "sketch", "roots", "shingles")
        links = materialise(by_cell(dealt, _linked(floor, percent), "a bigint, b bigint"), "links")
        comps = materialise(merged(comps, links), "components")
        release(spark)

    grouped = classes.select("set_key", "id").join(comps, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    out = summary.select("doc_id", "n_shingles", "set_key").join(grouped, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
