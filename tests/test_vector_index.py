import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import vector as V


def points(spark, n, clusters=30, dims=12):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(clusters, dims)) * 3
    v = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims))
    v[: n // 3] = v[0]  # a third are copies
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "point_id long, vector array<double>")


def exact(v, queries, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit[queries] @ unit.T, 5)
    return {q: sorted(range(len(v)), key=lambda j: (-s[j], j))[:k] for q, s in zip(queries, score)}


@pytest.mark.parametrize("chunk", [50_000, 10])
def test_probed_lists_find_most_and_all_lists_everything(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK", chunk)
    v, df = points(spark, 900)
    asked = df.where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    index = V.PartitionIndex(df, f"file://{tmp_path}/lists")
    assert 1 <= index.probes < len(index.centroids)
    want = exact(v, list(range(0, 900, 20)), 10)
    got = {}
    for r in index.search(asked, 10, probes=len(index.centroids)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    found = {(r.query_id, r.id) for r in index.search(asked, 10).collect()}
    hits = sum((q, i) in found for q, own in want.items() for i in own)
    assert hits >= 0.9 * 10 * len(want)
    assert spark.read.parquet(f"{tmp_path}/lists").count() == 900


def test_other_lists_are_not_read_and_empty_tables(spark, tmp_path):
    v, df = points(spark, 600)
    index = V.PartitionIndex(df, f"file://{tmp_path}/lists")
    one = df.where("point_id = 500").select(F.col("point_id").alias("query_id"), "vector")
    plan = index.search(one, 3, probes=1)
    filters = plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1:]
    assert filters and all("list" in f[:100] for f in filters), filters
    assert [r.id for r in plan.where("rank = 1").collect()] == [500]
    assert index.search(one.limit(0), 3).count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "point_id long, vector array<double>")
    got = V.PartitionIndex(zero, f"file://{tmp_path}/zero").search(zero.where("point_id = 2").withColumnRenamed("point_id", "query_id"), 5, probes=9)
    assert sorted((r.id, r.score) for r in got.collect()) == [(1, 0.0), (2, 1.0)]


@pytest.mark.parametrize("bytes_", [64 << 20, 3000])
def test_a_query_is_one_row_whatever_it_probes(spark, tmp_path, monkeypatch, bytes_):
    made, kept = [], V.durable
    monkeypatch.setattr(V, "durable", lambda df, name: made.append(kept(df, name)) or made[-1])
    monkeypatch.setattr(V, "QUERY_BYTES", bytes_)
    v, df = points(spark, 900)
    asked = df.where("point_id % 20 = 0").withColumnRenamed("point_id", "query_id")
    index = V.PartitionIndex(df, f"file://{tmp_path}/lists")
    got = {}
    for r in index.search(asked, 10, probes=len(index.centroids)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == exact(v, list(range(0, 900, 20)), 10)
    assert sum(df.count() for df in made) == 45 < 45 * len(index.centroids)
