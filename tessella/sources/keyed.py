"""Tables keyed by a column in hash buckets, of which a batch rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Buckets of a table, for its life; each is one directory and, with one writer a bucket, one file.
BUCKETS = 64
BUCKET, APPLIED = "bucket", "applied"


class KeyedTable:
    """Rows of `schema` by `key`, partitioned by the key's hash.

    A write reads and replaces the buckets of its keys (Spark's dynamic partition
    overwrite), so its cost goes with the batch and not with the table.  Each
    bucket keeps the version that was last applied to it; applying one again, or an
    older one, changes nothing, also where a write was broken off half way.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str, buckets: int = BUCKETS):
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.columns = [f.name for f in schema]
        self.schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema), T.StructField(APPLIED, T.LongType()), T.StructField(BUCKET, T.IntegerType())])

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(key if key is not None else self.key), F.lit(self.buckets)).cast("int")

    def stored(self, touched: list[int] | None = None) -> DataFrame:
        """The rows with their bucket and the version last applied to it; of some buckets, or all."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.schema)
        return rows if touched is None else rows.where(F.col(BUCKET).isin(touched))

    def rows(self) -> DataFrame:
        return self.stored().select(*self.columns)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of a batch's keys, of which there are `buckets` at most."""
        return sorted(r.b for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def replace(self, rows: DataFrame, version: int) -> None:
        """Writes whole buckets: all rows of theirs that shall stay."""
        made = rows.select(*self.columns, F.lit(version).cast("long").alias(APPLIED), self.bucket().alias(BUCKET))
        # The buckets' files are replaced when the job is committed, so they can be read until then.
        made.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def upsert(self, new: DataFrame, version: int) -> None:
        """The new rows, and the old ones with other keys; null keys are equal."""
        new = new.select(*self.columns)
        old = self.stored(self.touched(new))
        later = old.where(F.col(APPLIED) >= version).select(BUCKET).distinct()
        todo = new.withColumn(BUCKET, self.bucket()).join(F.broadcast(later), BUCKET, "left_anti").drop(BUCKET)  # a row a bucket
        kept = old.join(F.broadcast(later), BUCKET, "left_anti").select(*self.columns)
        keys = todo.select(F.col(self.key).alias("__new")).distinct()
        self.replace(kept.join(keys, F.col(self.key).eqNullSafe(F.col("__new")), "left_anti").unionByName(todo), version)
