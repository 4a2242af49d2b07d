"""Streams over the supplied events, run to their end, and the batch results that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.plans.registry import Registry, table
from tessella.session import shared_path
from tessella.streaming import consumer as S

query = Registry()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet as a stream of its files, with time zones made explicit."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str) -> DataFrame:
    """The stream's rows once it has read all there is, as a table in the cluster's shared folder."""
    spark = df.sparkSession
    path = shared_path(spark, "stream")
    schema = df.schema

    numbers = []

    def keep(batch: DataFrame, number: int) -> None:
        numbers.append(number)
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if mode == "complete":
        rows = spark.read.schema(schema).parquet(f"{path}/rows/batch={max(numbers)}")
    return rows


@query("select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as end, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def stream_tumbling_windows(spark, sf_dir):
    out = drained(S.windowed_counts(event_stream(spark, sf_dir), "ts", "event_type", value="value"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select date_trunc('hour', ts) - to_hours(o::int) as start, date_trunc('hour', ts) - to_hours(o::int) + interval 2 hour as end, event_type, count(*) as n from events, range(2) t(o) group by 1, 2, 3")
def stream_sliding_windows(spark, sf_dir):
    out = drained(S.windowed_counts(event_stream(spark, sf_dir), "ts", "event_type", size="2 hours", slide="1 hour"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("select event_id::varchar as event_id, event_type from events")
def stream_consume(spark, sf_dir):
    """Each event consumed once, its type kept by `apply`."""
    path = shared_path(spark, "consume")
    out = f"{path}/applied"

    def apply(batch: DataFrame, version: int) -> None:
        batch.select("event_id", "event_type").write.mode("overwrite").parquet(f"{out}/batch={version}")

    receipts = event_stream(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("digest"), "event_type")
    S.Consumer(spark, f"{path}/state", apply).start(receipts, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("event_id string, event_type string").parquet(out).select("event_id", "event_type")
