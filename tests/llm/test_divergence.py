import random
import re
from collections import Counter, defaultdict

import __spark_entry__ as entry
from tessella.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    """rows: text, lang, source."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for la, s in groups if la == lang)
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept)) if kept else 0
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top}
    return out


def rows_of(df):
    got = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def sample(seed, n, sources):
    """Terms of all frequencies, and sources of all sizes."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghÉßñ" for b in "klmnopqrstuvwxyz"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = rng.choice([None, "s0", "s0", "s0", *(f"s{int(rng.random() ** 2 * sources)}" for _ in range(4))])
        own = words[len(source) * 7 % 40 :: 3] if source and rng.random() < 0.5 else words
        rows.append((" ".join(own[int(rng.random() ** 3 * len(own))] for _ in range(rng.randint(0, 30))) + rng.choice(["", " A.B-c_D1e", "\n\tÀ\x00b"]), lang, source))
    return rows


def test_dense_tiles_and_corrections_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST", 4)
    for tile, block, bucket in ((256, 2048, 200_000), (4, 7, 40)):
        monkeypatch.setattr(divergence, "TILE", tile)
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "BUCKET", bucket)
        rows = sample(tile, 500, 14)
        df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(6)
        assert rows_of(divergence.audit(df)) == brute(rows, 4)


def test_all_heavy_and_all_light(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST", 3)
    rows = sample(5, 250, 9)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = brute(rows, 3)
    for dense in (10**6, 0):
        monkeypatch.setattr(divergence, "DENSE", dense)
        assert rows_of(divergence.audit(df)) == want


def test_groups_without_terms_ties_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST", 2)
    rows = [(None, "xx", "a"), ("", "xx", "b"), ("12 34", None, None), ("tie toe", "en", "a"), ("toe tie", "en", "b"), ("toe tie", "en", "b"), (None, "en", "c"), ("lone", "one", "only"), ("lone", "one", "only")]
    rows.append(("word " * 30_000 + "É" * 20, "en", "a"))
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert rows_of(divergence.audit(df)) == brute(rows, 2)
    assert divergence.audit(df.limit(0)).count() == 0


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Ab cdefghijklmnop 12 é" * 50
    assert [t for piece in divergence.terms(text.encode()) for t in piece] == [t.encode() for t in TERM.findall(text.translate(LOWER))]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = rows_of(entry.queries()["op13_source_divergence"](spark, sf_dir))
    assert got == brute([(r.text, r.lang, r.source) for r in docs], 30)
