import os

import pytest
from pyspark.sql import functions as F

from tessella.sources.keyed import KeyedTable
from tessella.streaming.consumer import Consumer


def files(path):
    """Every data file with its time of writing."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k", "k long, v string", 16)
    t.upsert(spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v")), 0)
    before = files(f"{tmp_path}/t")
    assert len(before) == 16
    t.upsert(spark.createDataFrame([(7, "b")], "k long, v string"), 1)
    after = files(f"{tmp_path}/t")
    assert len(after) == 16 and len(before.keys() - after.keys()) == 1 and all(after[f] == before[f] for f in before.keys() & after.keys())
    assert t.rows().count() == 2000 and [r.v for r in t.rows().where("k = 7").collect()] == ["b"]
    # An applied version, or an older one, changes nothing.
    t.upsert(spark.createDataFrame([(7, "c")], "k long, v string"), 1)
    t.upsert(spark.createDataFrame([(7, "d")], "k long, v string"), 0)
    assert files(f"{tmp_path}/t") == after


def test_null_keys_new_columns_order_and_empty_batches(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k", "k string, v int", 4)
    assert t.rows().count() == 0
    t.upsert(spark.createDataFrame([], "k string, v int"), 0)
    t.upsert(spark.createDataFrame([(1, None), (2, "x")], "v int, k string"), 1)
    t.upsert(spark.createDataFrame([(None, 3), ("y", 4)], "k string, v int"), 2)
    assert sorted(map(tuple, t.rows().collect()), key=repr) == sorted([(None, 3), ("x", 2), ("y", 4)], key=repr)


def test_a_write_that_broke_off_half_way_is_finished_once(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k", "k long, v long", 8)
    t.upsert(spark.range(80).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")), 0)
    new = spark.range(80).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    t.upsert(new.where(t.bucket("k") < 3), 1)  # what a broken write has reached
    done = files(f"{tmp_path}/t")
    t.upsert(new, 1)
    assert t.rows().where("v = k + 1").count() == 80
    assert len(done.items() & files(f"{tmp_path}/t").items()) == 3


def test_a_batch_costs_what_it_touches(spark, tmp_path):
    applied = []
    c = Consumer(spark, f"{tmp_path}/s", lambda df, n: applied.append(df.count()), buckets=32)
    c.batch(spark.range(100_000).select(F.col("id").cast("string").alias("event_id"), F.lit("d").alias("digest")), 0)
    before = files(f"{tmp_path}/s")
    one = spark.createDataFrame([("new", "d")], "event_id string, digest string")
    c.batch(one, 1)
    after = files(f"{tmp_path}/s")
    written = {f for f in after if before.get(f) != after[f]}
    # One bucket of the events and the marker.
    assert len(written) <= 3 and sum(os.path.getsize(f) for f in written) < sum(os.path.getsize(f) for f in after) / 8
    assert applied == [100_000, 1] and c.events().count() == 100_001 and not c.blocked()
    c.batch(one, 1)
    assert applied == [100_000, 1] and c.events().count() == 100_001


def test_marker_letters_and_a_batch_that_fails_between_its_writes(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "event_id string, digest string")
    applied = []
    c = Consumer(spark, f"{tmp_path}/s", lambda df, n: applied.append(sorted(r.event_id for r in df.collect())), buckets=4)
    assert tuple(c.marker().first()) == (-1, -1, False)
    c.batch(rows(("a", "1"), ("b", "1")), 0)
    upsert = KeyedTable.upsert

    def broken(self, new, version):
        if self is c.known:
            raise OSError("executor lost")
        upsert(self, new, version)

    monkeypatch.setattr(KeyedTable, "upsert", broken)
    with pytest.raises(OSError):
        c.batch(rows(("a", "2"), ("c", "1")), 1)
    assert tuple(c.marker().first()) == (1, 0, True)
    monkeypatch.setattr(KeyedTable, "upsert", upsert)
    c.batch(rows(("a", "2"), ("c", "1")), 1)
    assert tuple(c.marker().first()) == (1, 1, False) and applied == [["a", "b"], ["c"], ["c"]]
    assert [tuple(r) for r in c.dead_letters().select("event_id", "digest", "occurrences").collect()] == [("a", "2", 1)]
    c.batch(rows(("a", "2"), ("a", "3")), 2)
    assert sorted(tuple(r) for r in c.dead_letters().select("event_id", "digest", "occurrences", "first_batch", "last_batch").collect()) == [("a", "2", 2, 1, 2), ("a", "3", 1, 2, 2)]
