"""Exact dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import dedup, graph, nearjoin


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) + str(rng.randrange(1000)) for _ in range(n))


TEXTS = [None, "", " ", "a", "a", "A", "b\n", "b", long_text(1, 3000), long_text(1, 3000), long_text(1, 3000) + "x", "y" + long_text(1, 3000), "z" * 300_000, "z" * 300_000, "z" * 299_999]


@pytest.mark.parametrize("name", [dedup.identify, lambda chunk: hashlib.md5(chunk).digest()[:1]])
def test_exact_dedup(spark, name):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (4, "a"), (None, "a"), (None, "only"), (4, "a")]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, recipe string, kept int")
    got = sorted(map(tuple, dedup.exact_dedup(df, name=name).collect()), key=repr)
    assert got == brute_dedup(rows)
    assert dedup.exact_dedup(df.limit(0), name=name).collect() == []


def test_cuts_follow_the_content():
    data = long_text(2, 20_000).encode()
    ends = dedup.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert all(dedup.LEAST <= b - a <= dedup.MOST for a, b in zip([0, *ends], ends[:-1]))
    chunks = lambda d: {d[a:b] for a, b in zip([0, *dedup.cuts(d)], dedup.cuts(d))}
    moved = chunks(b"inserted at the front " + data)
    assert len(chunks(data) & moved) > 0.8 * len(moved)


def test_normalised_dedup(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in dedup.exact_dedup(df, normalise=F.lower).collect()}
    assert got == {1: 2, 2: 2, 3: 3}


def brute_sets(rows, size=5):
    out = []
    for i, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    return out


def brute_components(rows, percent=80):
    sets = brute_sets(rows)
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def edits(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(out) * share))):
        k = rng.randrange(len(out))
        act = rng.randrange(3)
        if act == 0:
            out[k] = f"new{rng.randrange(10**6)}"
        elif act == 1 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, f"ins{rng.randrange(10**6)}")
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "One two", "one  two", "É é", "a b c d e", "a b c d e f", "a b c d e f g h i j k l m n", "b c d e f g h i j k l m n"]
    for n in (5, 6, 7, 9, 12, 20, 40, 63, 64, 65, 90, 128, 129, 200, 500):
        base = [word() for _ in range(n)]
        texts.append(" ".join(base))
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05):
            texts.append(" ".join(edits(rng, base, share)))
        texts += [" ".join(base[: int(n * f)]) for f in (0.79, 0.8, 0.82, 0.9)] + [" ".join(base).upper()]
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(rng.randrange(10, 80))] + passage))
    chain = [word() for _ in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[k * 3 :] + [f"c{k}x{j}" for j in range(k * 3)]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    rows = list(enumerate(corpus(seed)))
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    assert sorted(map(tuple, nearjoin.jaccard_components(df).collect())) == brute_components(rows)


def test_large_groups_lose_no_link(spark, monkeypatch):
    """One chain of near copies among many documents that share a passage; groups of three already count as large."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000 - k, " ".join(base[k:] + [f"t{k}y{j}" for j in range(k)])) for k in range(0, 40, 2)]
    rows += [(k, " ".join(base[:100] + [f"u{rng.randrange(10**6)}" for _ in range(60)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nearjoin, "SMALL", 2)
    assert sorted(map(tuple, nearjoin.jaccard_components(df).collect())) == brute_components(rows)


@pytest.mark.parametrize("comparisons,block", [(1 << 60, 3), (0, 5)])
def test_hot_keys_lose_no_link(spark, monkeypatch, comparisons, block):
    """All keys count as hot, so all groups are dealt by salts; open groups go through blocks, or first through new centres."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000 - k, " ".join(base[k:] + [f"t{k}y{j}" for j in range(k)])) for k in range(0, 40, 2)]
    rows += [(k, " ".join(edits(rng, base, rng.choice([0.01, 0.02, 0.04])))) for k in range(30)]
    rows += [(2000 + k, " ".join(base)) for k in range(15)] + [(3000 + k, f"short text {k % 3}") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for name, value in (("HOT", -(10**9)), ("SALTED", 0.3), ("COMPARISONS", comparisons), ("BLOCK", block), ("PARTNERS", 6)):
        monkeypatch.setattr(nearjoin, name, value)
    assert sorted(map(tuple, nearjoin.jaccard_components(df).collect())) == brute_components(rows)


def test_repeated_ids_are_one_node(spark):
    a, b = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "x"), (None, a)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in nearjoin.jaccard_components(df).collect()), key=repr)
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (None, None)]
    assert nearjoin.jaccard_components(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == sorted((n, root(n)) for n in parent)
