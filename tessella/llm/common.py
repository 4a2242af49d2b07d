"""Shared plumbing of the training-data operators: durable tables, text slices, keyed filters."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessella.session import reachable, shared_dir, spread

#: Texts a Python worker handles at a time, in bytes.
SLICE_BYTES = 2 << 20
#: A side of a join is broadcast up to this many keys (8 to 40 bytes each), and shuffled beyond.
BROADCAST_KEYS = 1_000_000
#: ASCII white space, in Java's and Python's syntax; all else is part of words.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


#: Folders made in the shared one by this process and not yet removed.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    _made.append(path)
    return path


def clean() -> int:
    """Removes the tables and files that this process's operators left in the shared folder; their results can no longer be read.

    Results read those tables when they are used, so only the caller knows when
    to do this: after the last one is written or collected.
    """
    removed = 0
    while _made:
        store, path = fs.FileSystem.from_uri(_made.pop())
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
            removed += 1
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bounds the batches that go to Python workers, so that long texts do not add up; a row is never cut."""
    reachable(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns freed memory to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(work: Callable, release: Callable[[], None] | None = None) -> Callable:
    """work, after which a task's memos are emptied and freed memory is given back: workers live on, idle or for other operators."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            if release:
                release()
            give_back()

    return run


def text_slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about `most` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    """A column's field, nullable."""
    return T.StructField(alias or name, df.schema[name].dataType, True)


def schema_of(*fields: T.StructField | tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([f if isinstance(f, T.StructField) else T.StructField(*f, True) for f in fields])


def matched(df: DataFrame, keys: DataFrame, key: str, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Semi or anti join on one key, nulls equal: keys are broadcast only if counted to be few, else shuffled."""
    keys = keys.select(F.col(key).alias("__key"))
    few = keys.count() <= most
    return df.join(F.broadcast(keys) if few else keys, df[key].eqNullSafe(F.col("__key")), how)
