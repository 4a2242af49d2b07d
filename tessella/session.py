"""Session factory for scripts and tests; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a temporary one only on a local master where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders made in the shared one by this process and not yet removed.
_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which clean() removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    _made.append(path)
    return path


def clean() -> int:
    """Removes what this process left in the shared folder, but for indexes; results that read it can no longer be read.

    Results read their tables when they are used, so only the caller knows when to
    do this: after the last one is written or collected.
    """
    removed = 0
    while _made:
        store, path = fs.FileSystem.from_uri(_made.pop())
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
            removed += 1
    return removed


def durable(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine, or on a shared file system, import this package wherever the driver was started; elsewhere it is shipped with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deals an input of fewer files than cores to all cores, as a file can be one row group and so one task; the rule goes by files alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bounds the batches that go to Python workers, so that long texts do not add up; a row is never cut."""
    reachable(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about `most` bytes; a longer text is a part of its own."""
    if batch.num_rows:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def session(app: str = "tessella", **conf: str) -> SparkSession:
    """UTC, adaptive execution and skew-join splitting; partitions follow the cores in local mode."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return reachable(builder.getOrCreate())
