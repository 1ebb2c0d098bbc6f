"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_serial = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or a temporary one in tests."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get().rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{os.getpid()}-{next(_serial)}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop shuffle files of dead plans."""
    for path in paths:
        drop_path(spark, path)
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of variable-length values that Python works on at once; a single longer row is worked on alone.
BATCH_BYTES = 2 << 20


def sliced(batch: pa.RecordBatch, rows: int = 256, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and, unless one row has more, about ``size`` bytes."""
    weights = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            weights += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(weights), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Hand memory that is free in this worker back to the system: workers are reused, and what they keep is memory of their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker keeps no free memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` over slices bounded in rows and bytes, which bounds what Python holds at once; ``after`` runs at a task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in sliced(batch, rows):
                    if (out := function(part)) is not None:
                        yield out
        finally:
            if after is not None:
                after()

    return df.mapInArrow(tidied(run), schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, nulls as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def long_id(name: str) -> F.Column:
    return F.col(name).cast("long")
