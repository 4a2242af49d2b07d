import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.functions import markdown as M
from tessella.operators import cycles as Y, segments as G, vector as V
from tessella.streaming import consumer as W


def reachable(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for v in {x for e in edges for x in e}:
        todo, seen = list(out.get(v, ())), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found[v] = seen
    return found


@pytest.mark.parametrize("seed", range(3))
def test_cyclic_edges_against_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((30, 60, 120)[seed])]
    edges += [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (200, 200), (None, 1), (1, None), (100, 101)]
    got = {(r.a, r.b) for r in Y.cyclic_edges(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = {e for e in edges if None not in e}
    reach = reachable(real)
    assert got == {(a, b) for a, b in real if a in reach[b] or a == b}


def test_a_dense_core_is_coloured(spark):
    """No vertex has a single edge in or out: two cliques, one of which reaches the other."""
    clique = lambda k, n: [(k + i, k + j) for i in range(n) for j in range(n) if i != j]
    edges = clique(0, 5) + clique(10, 4) + [(i, 10 + j) for i in range(3) for j in range(3)]
    got = {(r.a, r.b) for r in Y.cyclic_edges(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == set(clique(0, 5) + clique(10, 4))


def test_tables_of_a_long_cycle_stay_below_its_edges(spark, monkeypatch):
    n, sizes = 20_000, []
    keep = Y.durable

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Y, "durable", counted)
    edges = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") + 1) % n).alias("b")).unionByName(spark.range(50).select((F.col("id") + n).alias("a"), F.col("id").alias("b")))
    out = Y.cyclic_edges(edges)
    assert out.count() == n and max(sizes) < 5 * (n + 50)


def test_interval_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(700):
        s = rng.choice([rng.uniform(-50, 50), float(rng.randrange(-20, 20))])
        rows.append((rng.choice(["k", "k", "m", None]), i, s, s + rng.choice([0.0, 1.0, 1.25, 2.0, rng.uniform(0, 40), -1.0])))
    df = spark.createDataFrame(rows, "k string, i int, s double, e double")
    want = set()
    for k, i, s, e in rows:
        for k2, j, s2, e2 in rows:
            hull = max(e, e2) - min(s, s2)
            if i < j and k == k2 and k and e > s and e2 > s2 and (min(e, e2) - max(s, s2)) / hull >= 0.8:
                want.add((k, i, j))
    got = [tuple(r) for r in V.iou_pairs(df, "k", "i", "s", "e").collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_interval_candidates_stay_in_proportion(spark):
    """One key of 100,000 spans: the cells' pairs are less than ten times the result."""
    i = F.col("id")
    df = spark.range(100_000).select(F.lit("k").alias("k"), i.alias("i"), (F.pmod(F.xxhash64(i), F.lit(1_000_000)) / 10).alias("s"), (5 + F.pmod(F.xxhash64(i, F.lit(1)), F.lit(900)) / 100).alias("l")).withColumn("e", F.col("s") + F.col("l"))
    out = V.iou_pairs(df, "k", "i", "s", "e")
    found = out.count()
    plan = V.iou_pairs(df, "k", "i", "s", "e", least=0.8)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    candidates = V._met(df.select(F.col("k").alias("key"), F.col("i").alias("id"), "s", "e", "l"), 0.8).count()
    assert found > 10_000 and candidates < 10 * found


@pytest.mark.parametrize("hot", [10**6, 60])
def test_digest_pointers_are_the_walk(spark, monkeypatch, hot):
    monkeypatch.setattr(G, "HOT", hot)
    rng = random.Random(hot)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), start + timedelta(seconds=rng.choice([rng.randrange(6000), rng.randrange(60) * 100])), i) for i in range(500)] + [("once", start, 1)]
    want = set()
    for session in {r[0] for r in rows}:
        own = sorted((t, i) for s, t, i in rows if s == session)
        since, calls, number = own[0][0], 1, 0
        for call, (t, _) in enumerate(own[1:], 2):
            if (t - since).total_seconds() >= 100 or calls + 1 >= 7:
                number, since, calls = number + 1, t, 0
                want.add((session, number, call, t))
            else:
                calls += 1
    df = spark.createDataFrame(rows, "session string, at timestamp_ntz, id int").repartition(3)
    got = [tuple(r) for r in W.digest_triggers(df, "session", "at", "id", every=7, seconds=100).select("session", "digest_no", "at_call", "at").collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_long_lines_and_blanks_take_linear_time():
    import time

    count = M.word_counter()
    for text in (" " * 10**6, "x" + " " * 10**6 + "y", "# a" + " " * 10**6 + "b", "word, " * 170_000, "x" * 10**6):
        began = time.process_time()
        M.chunks(text)
        spans = [s for a, b in M.section_bounds(text) for s in M.line_spans(text[a:b], count, 384, 64)]
        assert time.process_time() - began < 5
        assert spans[0][0] == 0 and all(count(text[a:b]) <= 384 or b - a == 1 for a, b in spans[:50])


def test_blocks_and_headings_by_hand():
    text = "# One #\r\nplain  \nmore\t\n\n```py\n# not a head\n\n```\nafter\n~~~\nopen ``` \n```\n#  \n## Two ##x\n#no\n####### seven\n   "
    assert list(M.blocks(text, 256)) == ["# One #", "plain\nmore", "```py\n# not a head\n\n```", "after", "~~~\nopen ``` \n```\n#  \n## Two ##x\n#no\n####### seven"]
    assert [M.heading(x) for x in ("# One #", "##  Two ##x", "#no", "####### s", "#", "# ", "#  ", "# ##", "#\t a b  ## ")] == [(1, "One"), (2, "Two ##x"), None, None, None, None, (1, " "), (1, "#"), (1, "a b")]


def test_reach_is_the_largest_that_fits():
    for limit in (1, 2, 7, 50):
        for most in (1, 3, 40, 1000):
            for guess in (1, 5, 64, 5000):
                assert M.reach(lambda n: n <= limit, most, guess) == min(limit, most)  # noqa: B023
    assert M.reach(lambda n: False, 10, 4) == 1


def test_spans_are_found_by_their_lines():
    from tessella.functions import markdown as M

    text, seen, count = "".join(f"line {i} has {'some ' * (i % 9)}words, and ends.\n" for i in range(2000)), [], M.word_counter()
    spans = M.line_spans(text, lambda t: seen.append(len(t)) or count(t), 384, 64)
    assert all(count(text[a:b]) <= 384 for a, b in spans) and spans[-1][1] == len(text)
    assert sum(seen) < 12 * len(text), sum(seen) / len(text)
