"""Similarity join of texts by MinHash sketches: every pair whose Jaccard similarity reaches a threshold.

A text's set holds its distinct lower-case words, as 64-bit fingerprints. Texts with equal sets are one class. One hash
order of all words, rare ones first, gives each class its bottom-k MinHash sketch: its first ``n - ceil(t * n) + 1`` words.
Two sets with a similarity of at least t share more words than either has outside its sketch, so their sketches meet in
a value: the buckets (one for each sketch value) lose no pair, whatever the hashes are. The order only decides how many
pairs meet in vain, so counts of words are kept for ``BUCKETS`` hashes of words rather than for words.

A pair is looked at in the bucket of its first common value only, if the words that follow there can still be enough, and
is decided on the full sets. First sizes and places meet, then sketches of the classes that can still have a candidate in a
bucket, and full sets of those that have one. In sets, the most common words have two bytes each instead of eight. No list of pairs is made on the way. Buckets with many classes are dealt block against block, so
a task holds about ``LIMIT`` classes or ``LIMIT_BYTES`` of sets for each side.

Edge cases: null and blank texts have no words and are similar to nothing, each a class of its own.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.library import tokens
from tessella.operators.fixpoint import shared_folder

#: Hashes of words that are counted.
BUCKETS = 1 << 22
#: Bits of a sketch value that come from the word's hash, below those of its frequency.
HASH_BITS = 26
#: The most common words, which have short names.
FREQUENT = 1 << 16
#: Classes, and bytes of full sets, of a block.
LIMIT, LIMIT_BYTES = 1000, 16 << 20
#: Buckets of up to so many classes are worked on together.
SMALL = 12
#: Words, or rows, that a task works on at once.
CHUNK_WORDS, CHUNK_ROWS = 1 << 20, 1 << 14


def _written(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _release(df: DataFrame, path: str | None = None) -> None:
    """Delete what nothing reads any more: a written table, and shuffle files of dead plans."""
    jvm = df.sparkSession._jvm
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    jvm.System.gc()


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and each row's length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, kind))


def _sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Full sets end to end, the common words by their short names, and each row's size."""
    parts = [_flat(rows[c]) for c in ("frequent", "rest")]
    size = sum(n.astype(np.int64) for _, n in parts)
    out, at = np.empty(int(size.sum()), np.int64), np.cumsum(size) - size
    for values, n in parts:
        out[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        at = at + n
    return out, size


def _sketched(shared, t: Fraction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key, copies, n, codes (the sketch's values) and the set as frequent and rest. ``shared`` has word frequencies and the most common words."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        (levels, common), (words, n) = shared.value, _flat(batch.column(2))
        hashes = words.view(np.uint64)
        codes = (levels[hashes & np.uint64(BUCKETS - 1)].astype(np.int64) << HASH_BITS) | (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort((row << 32) | codes, kind="stable")  # words come in their own order, which breaks ties
        words, codes = words[order], codes[order]
        size = n.astype(np.int64)
        length = size + size * t.numerator // -t.denominator + 1
        length[size * t.denominator < (size + 1) * t.numerator] = 0  # no other set is similar enough
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        name = np.minimum(np.searchsorted(common, words), len(common) - 1)
        known = common[name] == words
        rest = np.bincount(row[~known], minlength=len(n))
        sets = _lists((name[known] - FREQUENT // 2).astype(np.int16), n - rest, pa.int16()), _lists(words[~known], rest, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), _lists(codes[place < length[row]], length, pa.int32()), *sets], ["key", "copies", "n", "codes", "frequent", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(_flat(batch.column(2))[1]), 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_WORDS, "right")))
                yield sketch(batch.slice(at, stop - at))
                at = stop

    return run


class Bucket:
    """The rows of one bucket, or of two of its blocks."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, side: np.ndarray, codes: np.ndarray, size: np.ndarray, ends: np.ndarray, t: Fraction) -> None:
        self.n, self.pos, self.side, self.codes, self.size, self.ends, self.t = n, pos, side, codes, size, ends, t

    def _plausible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words from the bucket's value on are enough, in rows of the two blocks."""
        n, left = self.n, self.n - self.pos
        enough = np.minimum(left[i], left[j]) * (self.t.numerator + self.t.denominator) >= self.t.numerator * (n[i] + n[j])
        return enough & ((self.side[i] == 0) | (self.side[i] != self.side[j]))

    def pairs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates among small buckets, which begin at ``starts``; each in the bucket of its first common value."""
        length = np.diff(np.append(starts, len(self.n)))
        follow = np.repeat(starts + length, length) - np.arange(len(self.n)) - 1
        i = np.repeat(np.arange(len(self.n)), follow)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(follow) - follow, follow)
        good = self._plausible(i, j)
        i, j = i[good], j[good]
        shared = np.zeros(len(i), bool)
        for x in range(0, len(i), CHUNK_ROWS):
            keys = []
            for side in (i[x : x + CHUNK_ROWS], j[x : x + CHUNK_ROWS]):
                size = self.size[side]
                at = np.repeat(self.ends[side] - size - (np.cumsum(size) - size), size) + np.arange(size.sum())
                one = np.sort((np.repeat(np.arange(len(side)), size) << 32) | self.codes[at])
                keys.append(one[np.concatenate((one[:1] == one[:1], one[1:] != one[:-1]))])
            both = np.sort(np.concatenate(keys))
            shared[x + (both[1:][both[1:] == both[:-1]] >> 32)] = True
        return i[~shared], j[~shared]

    def matrix(self) -> np.ndarray:
        """Candidates of one large bucket, above the diagonal."""
        m = len(self.n)
        place = np.arange(m)
        good = self._plausible(place[:, None], place[None, :])
        good = np.triu(good, 1)
        row, code = np.repeat(place, self.size), self.codes
        for values, rows in _dense(row, code, m):
            if not good.any():
                break
            good[np.ix_(rows, rows)] &= (values @ values.T) == 0
        return good


def _dense(row: np.ndarray, value: np.ndarray, m: int, width: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """0/1 matrices of the values that several rows hold, the most common first, and their rows."""
    _, value, held = np.unique(value, return_inverse=True, return_counts=True)
    several = held[value] > 1
    row, value = row[several], value[several]
    rank = np.empty(len(held), np.int64)
    rank[np.argsort(-held, kind="stable")] = np.arange(len(held))
    value = rank[value]
    at, step = 0, 16
    most = int(value.max()) + 1 if len(value) else 0
    while at < most:
        mine = (value >= at) & (value < at + step)
        rows, where = np.unique(row[mine], return_inverse=True)
        made = np.zeros((len(rows), min(step, most - at)), np.float32)
        made[where, value[mine] - at] = 1
        yield made, rows
        at, step = at + step, width


def _by_cell(rows: DataFrame, function: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` of rows with several whole cells, and where the cells begin; cells of one row are left out."""

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell = table["cell"].to_numpy()
        first = np.concatenate(([True], cell[1:] != cell[:-1]))
        single = first & np.concatenate((first[1:], [True]))
        if (~single).any():
            table, first = table.filter(pa.array(~single)), first[~single]
            if (out := function(table, np.flatnonzero(first))) is not None and out.num_rows:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                cell = part.column(0).to_numpy()
                cut = int(np.argmax(cell == cell[-1]))  # where the last cell begins; rows are sorted
                if held and cut == 0 and held[-1].column(0)[-1].as_py() == cell[0]:
                    held.append(part)
                    continue
                yield from flush(pa.Table.from_batches([*held, part.slice(0, cut)])) if held or cut else ()
                held = [part.slice(cut)]
        if held:
            yield from flush(pa.Table.from_batches(held))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _buckets(rows: pa.Table, starts: np.ndarray, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows, starts, None) of all small buckets, then (rows, [0], candidates) of each large one; with candidates as a matrix."""
    ends = np.append(starts[1:], len(rows))
    n, pos, side = (rows[c].to_numpy().astype(np.int64) for c in ("n", "pos", "side"))
    codes, size = _flat(rows["earlier"]) if "earlier" in rows.column_names else (np.empty(0, np.int32), np.zeros(len(rows), np.int64))
    size = size.astype(np.int64)
    last = np.cumsum(size)
    small = ends - starts <= SMALL
    if small.any():
        mine = np.flatnonzero(np.repeat(small, ends - starts))
        length = (ends - starts)[small]
        i, j = Bucket(n[mine], pos[mine], side[mine], codes, size[mine], last[mine], t).pairs(np.cumsum(length) - length)
        yield mine[i], mine[j], None
    for x, y in zip(starts[~small], ends[~small], strict=True):
        good = Bucket(n[x:y], pos[x:y], side[x:y], codes[last[x] - size[x] : last[y - 1]], size[x:y], last[x:y], t).matrix()
        if good.any():
            yield np.arange(x, y), np.empty(0, np.int64), good


def _named(t: Fraction):
    """Rows that have a candidate in their cell; without their earlier sketch values, those that may have one."""

    def cells(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        hit = np.zeros(len(rows), bool)
        for i, j, good in _buckets(rows, starts, t):
            if good is None:
                hit[i] = hit[j] = True
            else:
                hit[i[good.any(axis=0) | good.any(axis=1)]] = True
        return rows.select(["cell", "key", "side", "pos"]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else None

    return cells


def _linked(t: Fraction, out: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]):
    """``out`` of the links of the cells: rows, places of both ends, common words."""

    def cells(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        words, size = _sets(rows)
        ends = np.cumsum(size)
        n, found = size.astype(np.int64), []
        for i, j, good in _buckets(rows, starts, t):
            if good is None:
                sets = {k: np.sort(words[ends[k] - size[k] : ends[k]]) for k in np.unique(np.concatenate((i, j)))}
                both = np.fromiter((_common(sets[p], sets[q]) for p, q in zip(i, j, strict=True)), np.int64, len(i))
            else:
                x, y = i[0], i[-1] + 1
                common = np.zeros((len(i), len(i)), np.float32)
                for values, held in _dense(np.repeat(np.arange(len(i)), size[x:y]), words[ends[x] - size[x] : ends[y - 1]], len(i)):
                    common[np.ix_(held, held)] += values @ values.T
                p, q = np.nonzero(good)
                i, j, both = x + p, x + q, common[p, q].astype(np.int64)
            enough = both * t.denominator >= t.numerator * (n[i] + n[j] - both)
            found.append((i[enough], j[enough], both[enough]))
        return out(rows, *(np.concatenate(c) for c in zip(*found, strict=True))) if found else None

    return cells


def _common(p: np.ndarray, q: np.ndarray) -> int:
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum())


def _counts(rows: pa.Table, i: np.ndarray, j: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
    """key, links, similar: other classes, and their texts, that each row links with."""
    links = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
    copies = rows["copies"].to_numpy()
    similar = np.zeros(len(rows), np.int64)
    np.add.at(similar, i, copies[j])
    np.add.at(similar, j, copies[i])
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rows["key"].to_numpy()[some]), pa.array(links[some]), pa.array(similar[some])], ["key", "links", "similar"])


def _pairs(rows: pa.Table, i: np.ndarray, j: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy().astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j]), pa.array(both / (n[i] + n[j] - both))], ["p", "q", "similarity"])


def _joined(df: DataFrame, id_col: str, text_col: str, least: float, out: Callable, schema: str) -> tuple[DataFrame, DataFrame]:
    """Texts (id, key), and what ``out`` makes of the links."""
    spark, t = df.sparkSession, Fraction(str(least))
    if not 0 < t <= 1:
        raise ValueError("the least similarity lies between 0 and 1")
    folder = f"{shared_folder(spark)}/similar-{uuid.uuid4().hex}"
    words = F.expr(f"sort_array(array_distinct(transform({tokens(f'`{text_col}`')}, w -> xxhash64(w))))")
    texts = df.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("key", F.when(F.size("words") > 0, F.xxhash64("words")))
    texts = _written(texts, folder, "texts")
    known = texts.where("key is not null")
    counts = _written(known.select(F.explode("words").alias("w")).groupBy("w").count().where("count > 1"), folder, "counts")
    sums = counts.groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.floor(F.log2(F.sum("count"))).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    levels[sums["bucket"].to_numpy()] = sums["level"].to_numpy()
    common = np.sort(counts.orderBy(F.desc("count"), "w").select("w").limit(FREQUENT).toArrow()["w"].to_numpy())
    shared = spark.sparkContext.broadcast((levels, common if len(common) else np.zeros(1, np.int64)))
    classes = known.groupBy("key").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    sets = _written(classes.mapInArrow(_sketched(shared, t), "key bigint, copies bigint, n int, codes array<int>, frequent array<smallint>, rest array<bigint>"), folder, "sets")
    ids = _written(texts.select("id", "key"), folder, "ids")
    _release(df, f"{folder}/texts")

    values = sets.select("key", "n", "codes", F.posexplode("codes").alias("pos", "code")).where("pos = 0 or codes[pos - 1] != code").drop("codes")
    blocks = F.greatest(F.ceil(F.count("*") / LIMIT), F.ceil(F.sum("n") * 8 / LIMIT_BYTES)).cast("int")
    met = values.groupBy("code").agg(F.count("*").alias("c"), blocks.alias("blocks")).where("c > 1").drop("c")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = values.select("key", "n", "pos", "code").join(met, "code").withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.when(F.col("blocks") == 1, F.col("code").cast("long")).otherwise(F.xxhash64("code", F.least("mine", "other"), F.greatest("mine", "other")))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    schema_named = "cell bigint, key bigint, side int, pos int"
    near = _written(_by_cell(dealt.select(cell.alias("cell"), "key", side.alias("side"), "pos", "n"), _named(t), schema_named), folder, "near")
    _release(df)
    earlier = F.slice("codes", F.lit(1), F.col("pos")).alias("earlier")
    named = _by_cell(near.join(sets.select("key", "n", "codes"), "key").select("cell", "key", "side", "pos", "n", earlier), _named(t), schema_named)
    named = _written(named, folder, "named")
    _release(df, f"{folder}/near")
    full = named.join(sets, "key").select("cell", "key", "side", "pos", "n", earlier, "copies", "frequent", "rest")
    return ids, _by_cell(full, _linked(t, out), schema)


def similar_texts(df: DataFrame, id_col: str, text_col: str, least: float = 0.5) -> DataFrame:
    """id, class_id, n_links, n_similar of every row.

    class_id is the smallest id with the same words, n_links the number of other classes whose Jaccard similarity with the
    row's is ``least`` or more, n_similar that of the rows in them.
    """
    texts, links = _joined(df, id_col, text_col, least, _counts, "key bigint, links bigint, similar bigint")
    links = links.groupBy("key").agg(F.sum("links").alias("n_links"), F.sum("similar").alias("n_similar"))
    classes = texts.where("key is not null").groupBy("key").agg(F.min("id").alias("class_id")).join(links, "key", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.join(classes, "key", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), none("n_links"), none("n_similar"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, least: float = 0.5) -> DataFrame:
    """a, b, similarity: all pairs of different classes, by their smallest ids, whose Jaccard similarity is ``least`` or more."""
    texts, links = _joined(df, id_col, text_col, least, _pairs, "p bigint, q bigint, similarity double")
    classes = texts.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    one = lambda c: classes.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id"))
    return links.join(one("p"), "p").join(one("q"), "q").select(F.least("p_id", "q_id").alias("a"), F.greatest("p_id", "q_id").alias("b"), "similarity")
