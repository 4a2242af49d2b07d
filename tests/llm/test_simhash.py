import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
from tessella.llm import common, simhash

DOCS = "doc_id long, text string, fp string, component string"


def brute_components(fps, ids):
    """Smallest id of each row's class; links at three differing bits or fewer."""
    n = len(fps)
    p = np.array([int(f, 16) for f in fps], np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 3
    seen, out = set(), [None] * n
    for i in range(n):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((ids[j] for j in group if ids[j] is not None), default=None)
        for j in group:
            out[j] = least
    return out


def by_spark(spark, texts):
    """Fingerprints from Spark's own XXH64, whose seed is 42, bit by bit."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(common.WORD), 0)
    rows = rows.select("i", words.alias("w")).where(F.size("w") > 0)
    few = F.array(F.array_join("w", " "))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda k: F.array_join(F.slice("w", k, 3), " "))
    h = rows.select("i", F.explode(F.when(F.size("w") < 3, few).otherwise(many)).alias("s")).select("i", F.xxhash64("s").alias("h")).collect()
    out = ["0" * 16] * len(texts)
    got = {}
    for r in h:
        got.setdefault(r.i, []).append(r.h & (1 << 64) - 1)
    for i, hs in got.items():
        out[i] = f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs)):016x}"
    return out


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in entry.queries()["op11_simhash"](spark, sf_dir).collect()}
    want = by_spark(spark, [r.text for r in docs])
    assert [got[r.doc_id].fingerprint for r in docs] == want
    assert [got[r.doc_id].component_id for r in docs] == brute_components(want, [r.doc_id for r in docs])


def test_nulls_ties_repeats_and_other_columns(spark):
    long = " ".join(f"w{i % 1013}" for i in range(140_000))
    rows = [(5, None), (4, ""), (9, " \t\n"), (1, "One two"), (2, "one  TWO"), (3, "one two three four five six"), (None, "one two three four five six"), (None, "alone in the world now"), (7, "É é"), (8, "é É"), (7, "É é"), (10, long), (11, long + " more")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()]
    fps = by_spark(spark, [t for _, t in rows])
    want = list(zip([i for i, _ in rows], fps, brute_components(fps, [i for i, _ in rows])))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {c for i, f, c in got if f == "0" * 16} == {4}
    assert simhash.simhash_components(df.limit(0)).count() == 0


def clusters(seed, n=3000):
    """Spread fingerprints, some close to others, a dense ball, and many with one lower half."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    flip = lambda x, k: x if not k else flip(x ^ (np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)), k - 1)
    half = (rng.integers(0, 1 << 32, n // 4, dtype=np.uint64) << np.uint64(32)) | np.uint64(77)
    return np.unique(np.concatenate([base, flip(base[: n // 4], 3), flip(base[: n // 4], 4), flip(np.full(n // 4, base[0]), 4), half, half ^ np.uint64(1 << 40)]))


def test_every_link_is_found_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 256)
    p = clusters(1)
    df = spark.createDataFrame([(x,) for x in p.view(np.int64).tolist()], T.StructType([T.StructField("fp", T.LongType())]))
    shards = simhash.links(df, 3)
    a, b = np.array([(r.a, r.b) for r in shards.collect()], np.int64).T.view(np.uint64)
    assert (np.bitwise_count(a ^ b) >= 1).all()
    ids = list(range(len(p)))
    want = brute_components([f"{x:x}" for x in p.tolist()], ids)
    forest = simhash.Forest(len(p))
    forest.join(np.searchsorted(p, a), np.searchsorted(p, b))
    assert forest.top(np.arange(len(p))).tolist() == want


@pytest.mark.parametrize("seed", [2, 3])
def test_trees_prune_and_lose_no_pair(seed):
    p = clusters(seed, 1200)
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 3))) if i != j}
    got, homes = set(), 0
    for mask in simhash.HALVES:
        tree = simhash.grow(p[::3], mask, 1, 3, 64)
        home = np.zeros(len(p), int)
        for _, rows, own in simhash.route(tree, p):
            assert len(rows) < len(p)
            home[rows[own]] += 1
            for x, y in simhash.search(p[rows], own, mask, 1, 3):
                got |= set(zip(rows[x].tolist(), rows[y].tolist()))
        homes += int((home == 1).all())
    assert homes == 2
    assert {tuple(sorted(x)) for x in got} == {tuple(sorted(x)) for x in want}
