import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import classify as C, ingest as N, substrings as U


def brute(texts, needles):
    return {(d, i, n, t.index(n) + 1) for d, t in texts if t is not None for i, n in needles if n is not None and n in t}


@pytest.mark.parametrize("count", [3, 60, 1500])
def test_pairs_against_brute_force(spark, monkeypatch, count):
    monkeypatch.setattr(U, "PIECE", 50)
    rng = random.Random(count)
    letters = "abcdeé日 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, word(rng.randrange(200))) for i in range(120)] + [(200, None), (201, ""), (None, "no id has éa日b here"), (202, "x" * 5000 + "éa日b tail")]
    needles = [(i, word(rng.choice([1, 2, 3, 7, 8, 9, 12]))) for i in range(count)]
    needles += [(10_000 + i, t[a : a + 30]) for i, (_, t) in enumerate(texts[:100]) if t for a in (0, len(t) // 2) if t[a : a + 30]] + [(-1, None), (-2, "éa日b"), (-3, "x" * 4000)]
    df, nd = spark.createDataFrame(texts, "doc long, t string").repartition(3), spark.createDataFrame(needles, "needle_id long, needle string")
    got = [tuple(r) for r in U.contains_pairs(df, nd, doc="doc", text="t").select("doc", "needle_id", "needle", "at").collect()]
    assert set(got) == brute(texts, needles) and len(got) == len(set(got)) > count


def test_empty_needles_and_tables(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "d int, t string")
    nd = spark.createDataFrame([(7, ""), (8, "b")], "needle_id int, needle string")
    assert sorted(map(tuple, U.contains_pairs(df, nd, doc="d", text="t").collect())) == [(1, 7, "", 1), (1, 8, "b", 2), (2, 7, "", 1)]
    assert U.contains_pairs(df, nd.limit(0), doc="d", text="t").count() == 0 and U.contains_pairs(df.limit(0), nd, doc="d", text="t").count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_no_plan_compares_all_pairs(spark, monkeypatch, few):
    """The same equi joins whether lists are broadcast or shuffled."""
    from tessella.operators import search

    monkeypatch.setattr(search, "FEW", few)
    df = spark.createDataFrame([(i, f"text {i} of many words") for i in range(50)], "d int, t string")
    nd = spark.createDataFrame([(i, f" {i} of") for i in range(40)], "needle_id int, needle string")
    out = U.contains_pairs(df, nd, doc="d", text="t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and out.count() == 40


def test_users_of_the_join(spark):
    items = spark.createDataFrame([(1, "Mail from BETA, then alpha"), (2, "alpha-one"), (3, "none"), (4, None)], "i int, t string")
    owners = spark.createDataFrame([("A", "alpha", 1), ("A1", "alpha-one", 2), ("B", "beta", 3), ("Z", "alpha", 0)], "owner string, signal string, place int")
    assert sorted(map(tuple, N.resolve_owner(items, owners, item="i", text="t").collect())) == [(1, "B"), (2, "A1")]
    names = spark.createDataFrame([("Alpha Beta",), ("alpha gamma",), ("solo",), ("Solo",)], "name string")
    asked = spark.createDataFrame([("alpha-beta",), ("gam",), ("alpha",), ("SOLO",), ("zz",)], "query string")
    got = {r.query: (r.name, r.kind) for r in C.name_lookup(names, asked).collect()}
    assert got == {"alpha-beta": ("Alpha Beta", "exact"), "gam": ("alpha gamma", "unique-substring"), "alpha": (None, "none"), "SOLO": ("Solo", "exact"), "zz": (None, "none")}


def test_anchors_are_rare_grams(spark):
    df = spark.createDataFrame([(i, "common phrase here " * 3) for i in range(200)] + [(999, "common phrase here zqzqzqzq")], "d int, t string")
    nd = spark.createDataFrame([(1, "here zqzqzqzq")], "needle_id int, needle string")
    counts = U._sampled_counts(df, "t")
    anchored = U._anchored(nd, counts)
    hits = U._hits(df, "d", "t", U._bloom(anchored), [8])
    assert [r.doc for r in hits.collect()] == [999]
    assert anchored.select(F.col("size")).first()[0] == 8
