import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import ingest as N, reporting as R, segments as G


@pytest.fixture(params=[10**6, 40])
def hot(request, monkeypatch):
    """Without cuts, and with groups cut from 40 rows on."""
    monkeypatch.setattr(G, "HOT", request.param)
    return request.param


def log(spark, n=600, one=0.7):
    rng = random.Random(4)
    rows = [("big" if rng.random() < one else rng.choice([None, "a", "b", "c"]), rng.randrange(n * 3), i, rng.randrange(10)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "session string, at long, id long, value long").repartition(5)


def by_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_totals_and_crossings(spark, hot):
    rows, df = log(spark)
    want, first = {}, {}
    for session, own in by_session(rows).items():
        total = 0
        for r in own:
            total += r[3]
            want[r[2]] = total
            if total >= 60:
                first.setdefault(session, r[2])
    assert {r.id: r.running for r in R.running_total(df, "session", "value", "at", "id").collect()} == want
    got = R.first_crossing(df, "session", "value", 60, "at", "id")
    assert {r.session: r.id for r in got.collect()} == first and sorted(got.columns) == sorted([*df.columns, "running"])


def test_islands(spark, hot):
    rows, df = log(spark)
    want = {}
    for own in by_session(rows).values():
        island = 0
        for a, b in zip([own[0], *own], own):
            island += b[1] - a[1] > 6
            want[b[2]] = island
    assert {r.id: r.island for r in R.islands(df, "session", F.col("at"), 6, "id").collect()} == want


def test_a_session_of_all_rows_is_cut(spark, monkeypatch):
    monkeypatch.setattr(G, "HOT", 500)
    df = spark.range(6000).select(F.lit("s").alias("session"), F.col("id").alias("at"), F.lit(1).alias("value"))
    cut = G.Segments(df, "session", "at")
    sizes = [r["count"] for r in cut.rows.groupBy(G.SEGMENT).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 6000 / 5
    out = R.running_total(df, "session", "value", "at")
    assert out.where("running = at + 1").count() == 6000


def test_as_of_against_brute_force(spark, hot):
    rng = random.Random(9)
    versions = [(rng.choice(["k", "k", "k", "m", None]), rng.choice([None, *range(80)]), f"v{i % 50}") for i in range(400)]
    points = [(i, rng.choice(["k", "k", "m", "none", None]), rng.choice([None, *range(90)])) for i in range(300)]
    v = spark.createDataFrame(versions, "key string, created int, name string")
    p = spark.createDataFrame(points, "id int, key string, at int")
    want = set()
    for i, key, at in points:
        own = [(c, n) for k, c, n in versions if k is not None and k == key and c is not None and at is not None and c <= at]
        if own:
            newest = max(own)
            want.add((i, key, at, *newest, sum(c == newest[0] for c, _ in own) > 1))
    got = N.as_of(p, v, "key", "at", "created").select("id", "key", "at", "created", "name", "ambiguous").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_as_of_sorts_points_and_versions_once(spark):
    p = spark.range(50).select(F.col("id"), F.lit("k").alias("key"), F.col("id").alias("at"))
    v = spark.range(20).select(F.lit("k").alias("key"), F.col("id").alias("created"), F.col("id").alias("name"))
    plan = N.as_of(p, v, "key", "at", "created")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Window ") == 1
