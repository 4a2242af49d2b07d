"""Append-only outboxes: units, then a manifest with their digest; and key-merged sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.functions.ids import bucketed_digest
from tessella.sources.keyed import KeyedTable

UNITS, MANIFEST = "units", "manifest"


def write_outbox(units: DataFrame, path: str, name: str, key: str = "unit_id") -> DataFrame:
    """Writes units under outbox=name and then its manifest row; returns the manifest.  An outbox that has a manifest is never written again."""
    spark = units.sparkSession
    if name in {r.outbox for r in manifests(spark, path).select("outbox").where(F.col("outbox") == name).collect()}:
        return manifests(spark, path).where(F.col("outbox") == name)
    place = f"{path}/{UNITS}/outbox={name}"
    units.write.mode("overwrite").parquet(place)
    stored = spark.read.parquet(place)
    row = bucketed_digest(stored, F.sha2(F.to_json(F.struct(*sorted(stored.columns))), 256)).select(F.lit(name).alias("outbox"), "n_rows", "digest")
    row.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return manifests(spark, path).where(F.col("outbox") == name)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/{MANIFEST}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "outbox string, n_rows long, digest string")
        raise


def read_outbox(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An outbox's units; fails without a manifest, or when its count or digest differs."""
    row = manifests(spark, path).where(F.col("outbox") == name).collect()
    if len(row) != 1:
        raise ValueError(f"outbox {name} has no complete manifest")
    units = spark.read.parquet(f"{path}/{UNITS}/outbox={name}")
    now = bucketed_digest(units, F.sha2(F.to_json(F.struct(*sorted(units.columns))), 256)).first()
    if (now.n_rows, now.digest) != (row[0].n_rows, row[0].digest):
        raise ValueError(f"outbox {name} differs from its manifest")
    return units


def equal_but(a: str, b: str, columns: list[str], volatile: list[str]) -> Column:
    """Whether two structs are equal, volatile fields aside."""
    names = [c for c in columns if c not in volatile]
    return F.struct(*(F.col(f"{a}.{c}") for c in names)).eqNullSafe(F.struct(*(F.col(f"{b}.{c}") for c in names)))


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Idempotent upsert: the new side's rows, and the old ones with other keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, version: int) -> DataFrame:
    """Merges rows into a table by key: only the hash buckets of the new keys are rewritten; a version that was applied changes nothing.

    The table's earlier state is gone: results that read it have to be written before.
    """
    table = KeyedTable(spark, path, key, new.schema)
    table.upsert(new, version)
    return table.rows()


def snapshot(cache: DataFrame, path: str) -> None:
    cache.write.mode("overwrite").json(path)


def restore(spark: SparkSession, path: str, schema, now: Column, most_seconds: float) -> DataFrame:
    """Cached rows (cached_at) that are young enough."""
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp")) <= most_seconds * 1_000_000)


def scan_table(points: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(points, keys that occur twice)."""
    return points, points.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def after(rows: DataFrame, key: str, checkpoint: int) -> DataFrame:
    """Rows beyond a checkpoint; the filter reaches the scan."""
    return rows.where(F.col(key) > checkpoint)
