"""The whole artifact search against a plain walk through its steps."""

import hashlib
import math
import random

import pytest

from tessella import api
from tessella.plans.checks import word_share

POLICY = {"exact_identifier_cross_min": 0.2, "agreement_cross_min": 0.5, "single_channel_cross_min": 0.7, "cross_margin_min": 0.1}


def fixture():
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "id-42", "omega", "zeta", "kappa"]
    spans, sources = [], {}
    for a in range(25):
        text, starts = "", []
        for _ in range(4):
            starts.append(len(text))
            text += " ".join(rng.choice(words) for _ in range(6)) + "\n"
        sources[f"art{a}"] = [f"rev{a}", text]
        for k, s in enumerate(starts):
            e = starts[k + 1] if k + 1 < len(starts) else len(text)
            body = text[s:e]
            spans.append((f"s{a:02}-{k}", f"art{a}", f"rev{a}", hashlib.sha256(body.encode()).hexdigest(), s, e, f"head {a % 3}", body, [float(body.count(c)) + 0.01 * ((a * 4 + k) % 7) for c in "abdgkmoz"], body.split(), [w for w in dict.fromkeys(body.split()) if "-" in w]))
    sources["art3"][0] = "newer"
    sources["art4"][1] = "!" + sources["art4"][1]
    del sources["art5"]
    asked = ["alpha id-42 beta", "gamma gamma delta", "nothing known", "omega zeta kappa alpha beta", "art zeta"]
    queries = [(i, t, [float(t.count(c)) + 0.02 for c in "abdgkmoz"]) for i, t in enumerate(asked)]
    return spans, queries, sources


def walk(spans, query, sources, mode, limit, policy):
    """(results, reason) of one query, step by step."""
    q_id, text, vec = query
    cos = lambda v: sum(a * b for a, b in zip(v, vec)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in vec))
    by_id = {s[0]: s for s in spans}
    near = sorted(((round(cos(s[8]), 5), s[0]) for s in spans), key=lambda x: (-x[0], x[1]))[:64]
    vector = {i: r for r, (_, i) in enumerate(near, 1)} if mode != "lexical" else {}
    terms = dict.fromkeys(w for w in text.split())
    n, avg = len(spans), sum(len(s[9]) for s in spans) / len(spans)
    df = {t: sum(t in s[9] for s in spans) for t in terms}
    score = {}
    for s in spans:
        total = 0.0
        for t in terms:
            if f := s[9].count(t):
                raw = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                total += (raw if raw > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(s[9]) / avg))
        if any(t in s[9] for t in terms):
            score[s[0]] = -total
    lexical = {i: r for r, i in enumerate(sorted(score, key=lambda i: (score[i], i))[:64], 1)} if mode != "vector" else {}
    fusion = {i: (1 / (60 + vector[i]) if i in vector else 0) + (1 / (60 + lexical[i]) if i in lexical else 0) for i in {**vector, **lexical}}
    ranked = sorted(fusion, key=lambda i: (-fusion[i], i))[:96]
    place = {i: r for r, i in enumerate(ranked, 1)}
    kept = []
    for i in ranked:
        s = by_id[i]
        same = lambda k: by_id[k][3] == s[3] or (by_id[k][2] == s[2] and max(0, min(by_id[k][5], s[5]) - max(by_id[k][4], s[4])) / (max(by_id[k][5], s[5]) - min(by_id[k][4], s[4])) >= 0.8)
        if not any(same(k) for k in kept):
            kept.append(i)
    cross = {}
    if mode == "hybrid-rerank":
        head = kept[:24]
        cross = dict(zip(head, word_share(text, [f"{by_id[i][1]}\n{by_id[i][6]}\n{by_id[i][7]}" for i in head])))
        cross_rank = {i: r for r, i in enumerate(sorted(head, key=lambda i: (-cross[i], i)), 1)}
        kept = sorted(head, key=lambda i: (-(0.75 / (60 + cross_rank[i]) + 0.25 / (60 + place[i])), place[i], i)) + kept[24:]
    good, failed, used = [], 0, {}
    for i in kept:
        s = by_id[i]
        source = sources.get(s[1])
        if source is None or source[0] != s[2] or hashlib.sha256(source[1][s[4] : s[5]].encode()).hexdigest() != s[3]:
            failed += 1
        elif used.get(s[1], 0) < 2:
            used[s[1]] = used.get(s[1], 0) + 1
            good.append(i)
    reason = None if good else "no-verified-result" if failed else "no-candidate"
    if policy and good:
        top, second = good[0], good[1] if len(good) > 1 else None
        c, margin = cross.get(top), cross[top] - cross[second] if second in cross and top in cross else None
        wide = margin is not None and margin >= policy["cross_margin_min"]
        exact = any("-" in t and t in by_id[top][10] for t in terms)
        if c is None:
            reason = "reranker-unavailable"
        elif not ((exact and c >= policy["exact_identifier_cross_min"]) or (top in vector and top in lexical and c >= policy["agreement_cross_min"] and wide) or (c >= policy["single_channel_cross_min"] and wide)):
            reason = "below-calibrated-threshold"
    return ([] if reason else good[:limit]), reason, failed


@pytest.mark.parametrize("mode,policy", [("hybrid-rerank", POLICY), ("hybrid-rerank", None), ("vector", None), ("lexical", None), ("hybrid", POLICY)])
def test_search_against_the_walk(spark, mode, policy):
    spans, queries, sources = fixture()
    s = spark.createDataFrame(spans, "span_id string, artifact_id string, revision_id string, span_sha256 string, start int, end int, heading string, content string, vector array<double>, tokens array<string>, identifiers array<string>")
    q = spark.createDataFrame(queries, "query_id int, text string, vector array<double>")
    c = spark.createDataFrame([(a, *x) for a, x in sources.items()], "artifact_id string, revision_id string, content string")
    results, decisions, failures = api.retrieve(s, q, c, mode=mode, limit=4, scorer=word_share, policy=policy)
    got = {}
    for r in results.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    reasons = {r.query_id: r for r in decisions.collect()}
    failed = {r.query_id: r["count"] for r in failures.groupBy("query_id").count().collect()}
    answered = 0
    for query in queries:
        want, reason, lost = walk(spans, query, sources, mode, 4, policy)
        assert got.get(query[0], []) == want and reasons[query[0]].reason == reason, (query, got.get(query[0]), want)
        assert reasons[query[0]].abstained == (reason is not None) and failed.get(query[0], 0) == lost
        answered += bool(want)
    assert answered or policy
    assert {r.reason for r in failures.select("reason").distinct().collect()} <= {api.NOT_CURRENT, api.NO_SOURCE, api.OTHER_HASH}


def test_arguments(spark):
    for bad in ({"mode": "other"}, {"limit": 0}, {"limit": 26}, {"scorer": None}):
        with pytest.raises(ValueError):
            api.retrieve(None, None, None, **{"scorer": word_share, **bad})


def test_identifiers_of_candidates_are_made_from_their_content(spark):
    spans, queries, sources = fixture()
    s = spark.createDataFrame(spans, "span_id string, artifact_id string, revision_id string, span_sha256 string, start int, end int, heading string, content string, vector array<double>, tokens array<string>, identifiers array<string>")
    q = spark.createDataFrame(queries, "query_id int, text string, vector array<double>")
    c = spark.createDataFrame([(a, *x) for a, x in sources.items()], "artifact_id string, revision_id string, content string")
    given, made = (sorted(map(tuple, api.retrieve(x, q, c, scorer=word_share, policy=POLICY)[1].collect()), key=repr) for x in (s, s.drop("identifiers")))
    assert given == made


def test_words_are_counted_as_the_pattern_finds_them():
    import re

    from tessella.functions.markdown import word_counter

    count, pattern, rng = word_counter(), re.compile(r"\w+|[^\w\s]"), random.Random(5)
    signs = [chr(i) for i in range(260)] + list("\u0301\u0661\u2014\u2028\u3000\u4e2d\U0001f642")
    for n in range(3000):
        text = "".join(rng.choice(signs[: (128, 256, 300)[n % 3]]) for _ in range(n % 30))
        assert count(text) == len(pattern.findall(text)), repr(text)


def test_letters(spark):
    from pyspark.sql import functions as F

    from tessella.plans.checks import letters

    rows = spark.createDataFrame([("abBa\u00e4 zz\n",), ("",), (None,)], "t string").select("t", letters(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == [[2.0, 1.0] + [0.0] * 23 + [2.0], [0.0] * 26, [None] * 26]
