from pyspark.sql import functions as F

from tessella.operators import reporting as R


def test_numbers_of_many_rows_are_those_of_the_order(spark, tmp_path):
    """Ranges of a table larger than its sample: they are drawn once, so no two readings cut it in different places."""
    spark.range(200_000, numPartitions=8).select("id", F.xxhash64("id").alias("at")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").orderBy("at").withColumn("v", F.struct("at", "id"))
    got = sorted((r.at, r.n) for r in R.numbered_rows(rows, "v").select("at", "n").collect())
    assert [n for _, n in got] == list(range(len(got)))
