import hashlib
import random
import zlib
from fractions import Fraction

import pytest

import __spark_entry__ as entry
from tessella.llm import catalog, periodic


def brute(word, least=24, times=3):
    """Every period by itself: stretches whose items that far apart are equal."""
    best = {}
    for q in range(1, len(word) // times + 1):
        i = 0
        while i + q < len(word):
            a = i
            while i + q < len(word) and word[i] == word[i + q]:
                i += 1
            if i > a and i + q - a >= max(least, times * q):
                best.setdefault((a, i + q), q)
            i += i == a
    return sorted((a, b - a, q) for (a, b), q in best.items())


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    found = 0
    for _ in range(400):
        n, letters = rng.randint(0, 140), rng.choice([1, 2, 2, 3, 6])
        word = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            for i in range(a, min(n, a + p * rng.randint(2, 7) + rng.randrange(p + 1))):
                word[i] = word[a + (i - a) % p]
        if rng.random() < 0.2:
            word = word + [9] + word + word
        least = rng.choice([3, 6, 9, 24])
        want = brute(word, least)
        assert periodic.runs(word, least) == want
        assert periodic.text_runs([b"%d" % w for w in word], least) == want
        found += len(want)
    assert found > 300


def test_a_fibonacci_word_and_a_power():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert periodic.runs(b, 6) == brute(b, 6)
    assert periodic.runs([4] * 5000) == [(0, 5000, 1)]
    long = list(range(3000)) * 3 + [1]
    assert periodic.runs(long) == [(0, 9000, 3000)]


def test_factors_are_the_longest_that_begin_earlier():
    rng = random.Random(1)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        cuts = periodic.Automaton(w).factors(w)
        for (i, back), (j, _) in zip(cuts, cuts[1:] + [(len(w), 0)]):
            assert back == 0 or w[i:j] == w[i - back : j - back]
            longest = max((next((k for k in range(len(w) - i) if w[i + k] != w[s + k]), len(w) - i) for s in range(i)), default=0)
            assert j - i == max(1, longest)


def described(text):
    words = (text or "").encode().split()
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return found, kept


def test_operator_on_odd_rows(spark):
    block = " ".join(f"w{i}" for i in range(9))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "a\t" * 24), (6, " ".join([block] * 3)), (None, " ".join([block] * 4) + " end"), (6, "é " * 30), (7, " ".join(f"x{i}" for i in range(50_000)) + " " + " ".join(["p q r"] * 20_000))]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    got = {(r.doc_id, r.collapsed): ([tuple(x) for x in r.runs], r.n_words) for r in periodic.find_runs(df.select("doc_id", "text", "n_words"), keep=["doc_id"]).collect()}
    want = {}
    for i, t in rows[:-1]:
        found, kept = described(t)
        want[i, kept.decode()] = (found, len((t or "").encode().split()))
    want[7, " ".join(f"x{i}" for i in range(50_000)) + " p q r"] = ([(50_000, 60_000, 3)], 110_000)
    assert got == want
    assert periodic.find_runs(df.limit(0), keep=["doc_id"]).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    with_runs = 0
    for i, text in docs.items():
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        found, kept = described(b" ".join(words).decode())
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        with_runs += bool(found)
    assert with_runs > 5


def test_planted_rows_without_words_or_id(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], " "), (None, "a b c"), (ids[3], "one")], "doc_id long, text string")
    assert sorted(catalog.planted(df).collect(), key=repr) == sorted(df.collect(), key=repr)
