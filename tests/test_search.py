"""Search, fusion, evaluation: hand-derived values and independent engines."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate as E, search as S, vector as V


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_id int, title string, content string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def run(spark, d, *texts, k=10):
    return [(r.query_id, r.doc_id, round(r.score, 5)) for r in S.tfidf_search(d, asked(spark, *texts), k=k).orderBy("query_id", "rank").collect()]


def test_idf_can_be_zero_or_negative(spark):
    d = docs(spark, (1, "t1", "apple pear"), (2, "t2", "apple plum"), (3, "t3", "apple pear fig"))
    assert run(spark, d, "apple") == [(0, i, round(math.log(3 / 4) * 2, 5)) for i in (1, 2, 3)]
    assert run(spark, d, "pear") == []  # in N - 1 documents: idf 0, rows dropped
    assert run(spark, d, "fig") == [(0, 3, round(math.log(3 / 2) * 2, 5))]


def test_title_parts_boost_but_make_no_candidate(spark):
    d = docs(spark, (1, "alpha-beta", "gamma"), (2, "delta", "epsilon"), (3, "zeta", "eta"))
    assert run(spark, d, "beta") == []
    both = run(spark, d, "beta gamma")
    # beta has no posting: idf ln(3 / 1), boost 3; gamma: tf 1, idf ln(3 / 2); both of two terms match.
    assert both == [(0, 1, round((3 * math.log(3) + math.log(1.5)) * 2, 5))]


def test_repeated_query_terms_count_twice(spark):
    d = docs(spark, (1, "x1", "gamma gamma"), (2, "x2", "delta"), (3, "x3", "eta"))
    assert run(spark, d, "gamma gamma delta")[0] == (0, 1, round(2 * 2 * math.log(1.5) * (1 + 2 / 3), 5))


def test_snippet(spark):
    d = docs(spark, (1, "t", "a" * 500 + " needle " + "b" * 500), (2, "t", "short"))
    r = S.snippets(spark.createDataFrame([(0, 1), (0, 2)], "query_id int, doc_id int"), d, asked(spark, "needle")).orderBy("doc_id").collect()
    assert r[0].snippet == "..." + "a" * 199 + " needle " + "b" * 193 + "..." and r[1].snippet == "short"


def test_bm25_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(a, b, c, d, tokenize = 'unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("sqlite has no fts5")
    rows = [("x1 id", "docs path", "heading one", "alpha beta beta gamma"), ("x2", "docs", "two", "alpha alpha delta"), ("id", "plans alpha", "three", "beta epsilon zeta"), ("x4", "src", "four four", "eta theta"), ("x5", "src path", "alpha", "iota kappa lambda mu nu")]
    con.executemany("insert into t values (?, ?, ?, ?)", rows)
    df = spark.createDataFrame([(i + 1, *(c.split() for c in r)) for i, r in enumerate(rows)], "span_id int, a array<string>, b array<string>, c array<string>, d array<string>")
    for query in (["alpha"], ["beta", "path"], ["id", "four", "nu"], ["absent"]):
        want = {r[0]: r[1] for r in con.execute("select rowid, bm25(t, 8.0, 2.0, 4.0, 1.0) from t where t match ?", (" OR ".join(query),))}
        q = spark.createDataFrame([(1, t) for t in query], "query_id int, term string")
        got = {r.id: r.bm25 for r in S.bm25_scores(df, q, list(zip("abcd", S.BM25_WEIGHTS))).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def points(spark):
    rows = [(i, [math.cos(i), math.sin(i), 0.5], i % 3, ["x", "y"] if i % 2 else ["x"]) for i in range(40)]
    return spark.createDataFrame(rows, "point_id long, vector array<float>, label int, tags array<string>")


def test_knn_is_brute_force(spark):
    p = points(spark).repartition(5)
    q = p.where("point_id < 4").withColumnRenamed("point_id", "query_id")
    got = V.knn(p, q, k=7).orderBy("query_id", "rank").collect()
    rows = {r.point_id: r.vector for r in p.collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for a in range(4):
        want = sorted(((-round(sum(x * y for x, y in zip(rows[a], v)) / norm(v) / norm(rows[a]), 5), i) for i, v in rows.items()))[:7]
        assert [(-r.score, r.id) for r in got if r.query_id == a] == want
    assert V.knn(p, q.limit(0)).collect() == [] and V.knn(p.limit(0), q).collect() == []


def test_knn_in_blocks_is_knn(spark, monkeypatch):
    p = points(spark).repartition(5)
    q = p.where("point_id < 10").withColumnRenamed("point_id", "query_id")
    whole = V.knn(p, q, k=7).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(V, "QUERY_BYTES", 3 * 24)
    assert len(whole) == 70 and V.knn(p, q, k=7).orderBy("query_id", "rank").collect() == whole


def test_filters(spark):
    p = points(spark)
    assert V.equality_filters(p, label=1, tags="y", point_id=None).count() == len([i for i in range(40) if i % 3 == 1 and i % 2])


def test_fusion_keeps_gaps(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 5)], "query_id int, id string, rank int")
    l = spark.createDataFrame([(1, "b", 2), (1, "c", 3)], "query_id int, id string, rank int")
    got = {r.id: (r.fusion_rank, r.fusion_score) for r in V.fuse(v, l).collect()}
    assert got["b"] == (1, 1 / 65 + 1 / 62) and got["a"] == (2, 1 / 61) and got["c"] == (3, 1 / 63)


def test_iou_edge(spark):
    row = spark.sql("select 0 as a, 100 as b, 0 as c, 80 as d, 79 as e")
    got = row.select(V.iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), V.iou(F.col("a"), F.col("b"), F.col("c"), F.col("e")).alias("y")).first()
    assert got.x >= V.IOU > got.y


def test_collapse_is_a_fold_and_not_transitive(spark):
    rows = [(1, "a", 1, "r", "h1", 0, 100), (1, "b", 2, "r", "h2", 10, 110), (1, "c", 3, "r", "h3", 20, 120), (1, "d", 4, "other", "h4", 0, 100), (1, "e", 5, "zz", "h1", 0, 100)]
    df = spark.createDataFrame(rows, "query_id int, id string, rank int, revision_id string, span_sha256 string, start int, end int").repartition(3)
    got = {r.id: r.alternates for r in V.collapse(df).collect()}
    # b is near a; c is near b but not near a; d is of another revision; e is a's copy.
    assert got == {"a": ["b", "e"], "c": [], "d": []}
    again = df.join(V.collapse(df).select("query_id", "id"), ["query_id", "id"])
    assert {r.id for r in V.collapse(again).collect()} == {"a", "c", "d"}


def test_rerank_blends_the_head_and_keeps_the_tail(spark):
    df = spark.createDataFrame([(1, "q", f"d{i:02}", f"c{i}", i) for i in range(1, 31)], "query_id int, query string, id string, content string, fusion_rank int")
    got = V.rerank(df, lambda q, texts: [float(t[1:]) for t in texts]).orderBy("final_rank").collect()
    blend = sorted(range(1, 25), key=lambda i: -(0.75 / (60 + 25 - i) + 0.25 / (60 + i)))
    assert [r.id for r in got[:24]] == [f"d{i:02}" for i in blend] and [r.fusion_rank for r in got[24:]] == list(range(25, 31))
    with pytest.raises(Exception):
        V.rerank(df, lambda q, texts: [float("nan")] * len(texts)).collect()


def test_cap_counts_verified_rows(spark):
    df = spark.createDataFrame([(1, "a", i, i != 1) for i in range(1, 5)], "query_id int, artifact string, rank int, ok boolean")
    assert [r.rank for r in V.cap(df, "artifact", verified=F.col("ok")).orderBy("rank").collect()] == [2, 3]


def test_rank_metrics(spark):
    results = spark.createDataFrame([(1, "x", 1), (1, "b", 2), (1, "c", 3), (1, "b", 4), (2, "z", 1)], "query_id int, id string, rank int")
    truth = spark.createDataFrame([(1, "b", 3), (1, "c", 1), (2, "q", 2)], "query_id int, id string, grade int")
    got = {r.query_id: r for r in E.rank_metrics(results, truth).collect()}
    ndcg = (7 / math.log2(3) + 1 / math.log2(4)) / (7 / math.log2(2) + 1 / math.log2(3))
    assert (got[1].hit, got[1].reciprocal_rank) == (1.0, 0.5) and abs(got[1].ndcg - ndcg) < 1e-12
    assert (got[2].hit, got[2].reciprocal_rank, got[2].ndcg) == (0.0, 0.0, 0.0)


def test_score_queries_and_macro(spark):
    gold = spark.createDataFrame([(1, True, False, None, ["n"]), (2, False, True, "old", []), (3, False, False, "old", [])], "query_id int, answerable boolean, abstained boolean, expected_revision string, hard_negative_paths array<string>")
    results = spark.createDataFrame([(1, "b", 1, "p", "r1", True, True, True), (1, "x", 2, "n", "r2", False, True, False), (3, "y", 1, "p", "old", True, True, True)], "query_id int, id string, rank int, path string, revision_id string, current boolean, source_verified boolean, span_verified boolean")
    truth = spark.createDataFrame([(1, "b", 3, "p", "r1")], "query_id int, id string, grade int, path string, revision_id string")
    got = {r.query_id: r for r in E.score_queries(gold, results, truth).collect()}
    assert got[1].citation_correct and got[1].hard_negative_slots == 1 and got[1].verified_hash_slots == 1 and got[1].noncurrent_or_historical_slots == 1
    assert got[2].classification_correct and got[2].citation_correct is None
    assert got[3].historical_target_leaks == 1 and not got[3].classification_correct
    m = E.macro_metrics(E.score_queries(gold, results, truth)).first()
    assert (m.hit_at_k, m.negative_abstention, m.hash_rate) == (1.0, 0.5, 2 / 3)


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21])
def test_both_percentiles(spark, n):
    df = spark.range(1, n + 1).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    nearest = df.agg(F.expr("percentile_disc(0.95) within group (order by v)").alias("a")).first().a
    floor = E.floor_index(df, "g", "v", {"b": 0.95}).first().b
    assert nearest == max(1, math.ceil(0.95 * n)) and floor == int((n - 1) * 0.95) + 1


def test_candidate_thresholds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    got = sorted(r.threshold for r in E.candidate_thresholds(df, "v").collect())
    assert [round(x, 6) for x in got] == [0, 0, 2, 4, 6, 8, 9, 9] and got[0] < 0 and got[-1] > 9
    assert [r.threshold for r in E.candidate_thresholds(df.limit(0), "v").collect()] == [0.0]


def test_checks(spark):
    df = spark.createDataFrame([(1.0, ">=", 1.0), (float("nan"), ">=", 0.0), (float("inf"), ">=", 0.0), (None, "<", 1.0), (2.0, "??", 1.0), (1.0, "==", 1.0)], "o double, op string, t double")
    assert [r.v for r in df.select(E.check_verdict(F.col("o"), F.col("op"), F.col("t")).alias("v")).collect()] == [True, False, False, False, None, True]


def test_identifiers_of_every_document(spark, tmp_path):
    import re

    from tessella.functions import text as X
    from tessella.plans import search

    texts = [" ".join(f"word id-{i % 70} x{i}.y" for i in range(100)), "abc ab-1 plain abc1 ab-1", "none here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, t) for i, x in enumerate(texts) for t in list(dict.fromkeys(t for t in re.findall(X.TERM, x or "") if re.search(X.IDENTIFIER, t)))[:64]}
    got = [tuple(r) for r in search.query.queries["identifier_tokens"](spark, str(tmp_path)).select("doc_id", "identifier").collect()]
    assert len(got) == 66 and set(got) == want


def test_a_search_holds_no_more_than_a_few_rows_a_query():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    # Points that come ever nearer to the queries, and copies: the most that a search can meet.
    near = np.concatenate([np.sort(rng.random(6000)), np.full(6000, 0.5)]).repeat(2)[:16_000]
    scores = near + rng.normal(scale=1e-4, size=(V.TILE, 1))
    tracemalloc.start()
    best = V._Best(V.TILE, 10)
    for i in range(0, 16_000, V.TILE):
        best.add(scores[:, i : i + V.TILE].copy(), np.arange(i, min(i + V.TILE, 16_000)), 5)
    q, score, name = best.cut()
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
    rounded = np.round(scores, 5) + 0.0
    for r in range(0, V.TILE, 97):
        want = sorted(range(16_000), key=lambda j: (-rounded[r, j], j))[:10]
        assert name[q == r].tolist() == want and score[q == r].tolist() == rounded[r, want].tolist()


def test_points_are_searched_by_no_more_tasks_than_cores(spark):
    many = spark.range(0, 400, numPartitions=80).select(F.col("id").alias("point_id"), F.array((F.col("id") % 7 - 3).cast("double"), F.lit(1.0)).alias("vector"))
    assert V._dealt(many).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = V.knn(many, many.where("point_id = 6").withColumnRenamed("point_id", "query_id"), k=3)
    assert [r.id for r in got.orderBy("rank").collect()] == [6, 13, 20]


def test_judgments_do_not_grow_with_a_label(spark):
    from tessella.plans.search import judgments

    p = spark.range(2000).select(F.col("id").alias("point_id"), F.array(F.lit(1.0)).alias("vector"), (F.col("id") % 2).alias("label"))
    hits = spark.createDataFrame([(0, 1998, 0, 0, 1), (0, 7, 1, 0, 2), (20, 0, 0, 0, 1)], "query_id long, id long, label long, query_label long, rank int")
    got = {}
    for r in judgments(p, hits, 10).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    assert len(got) == 100 and max(map(len, got.values())) <= 21
    assert got[0] == {*range(2, 22, 2), 1998} and got[20] == {*range(0, 20, 2)}


def test_queries_of_the_same_terms_are_scored_once(spark):
    rows = spark.createDataFrame([(i, ["a"] if i % 2 else ["a", "b"]) for i in range(40)], "span_id long, tokens array<string>")
    terms = spark.createDataFrame([(q, t) for q in range(6) for t in (("a",) if q % 2 else ("b", "a"))], "query_id long, term string")
    want = S.top_k(S.bm25_scores(rows, terms, [("tokens", 1.0)]), 5, "bm25", "id").select("query_id", "id", "bm25", "rank")
    assert sorted(map(tuple, S.bm25_top(rows, terms, [("tokens", 1.0)], 5).collect())) == sorted(map(tuple, want.collect()))


def test_scores_of_a_document_are_summed_where_its_postings_are(spark):
    """No row a query and document is shuffled: documents are dealt once, by id."""
    import re

    d = docs(spark, *((i, f"t{i}", f"apple w{i % 5} w{i % 3}") for i in range(60)))
    terms = S.query_tokens(asked(spark, "apple w1", "w2 w0"))
    scores = S.tfidf_scores(S.postings(d, terms), terms, 60, cut=True)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", scores._jdf.queryExecution().executedPlan().toString())


def test_rows_are_scored_where_they_are(spark, monkeypatch):
    """No row a query and id is shuffled, and neither tasks nor tiles change a result; ties go by id."""
    import random
    import re

    rng = random.Random(3)
    data = [(f"s{i}", [rng.choice("abcdefgh") for _ in range(i % 9)] if i % 31 else None, ["z"] if i % 4 else []) for i in range(300)]
    data += [(f"t{i}", ["c", "a", "e", "a"], []) for i in range(40)]
    rows = spark.createDataFrame(data, "span_id string, tokens array<string>, more array<string>")
    terms = spark.createDataFrame([(q, t) for q in range(7) for t in {*"abcdefghz"[q : q + 3], "a", "none"}] + [(9, "none")], "query_id int, term string")
    columns = [("tokens", 1.0), ("more", 2.0)]
    monkeypatch.setattr(S.V, "TILE", 64)
    plan = S.bm25_top(rows, terms, columns, 20)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id", plan)
    first = sorted(map(tuple, S.bm25_top(rows, terms, columns, 20).collect()))
    monkeypatch.setattr(S.V, "TILE", 3)
    monkeypatch.setattr(S, "SUMS", 4)
    assert first == sorted(map(tuple, S.bm25_top(rows.repartition(3), terms, columns, 20).collect()))
    scores = S.bm25_scores(rows, terms, columns).withColumn("bm25", F.round("bm25", 9))
    want = sorted((r.query_id, r.rank, r.id, r.bm25) for r in S.top_k(scores, 20, "bm25", "id").collect())
    assert sorted((q, rank, i, round(s, 9)) for q, i, s, rank in first) == want and len({q for q, *_ in first}) == 7
    monkeypatch.setattr(S, "FEW", 0)
    joined = {(r.query_id, r.rank): r.bm25 for r in S.bm25_top(rows, terms, columns, 20).collect()}
    assert joined == {(q, rank): pytest.approx(s) for q, _, s, rank in first}
    none = spark.createDataFrame([(1, "x")], "query_id int, term string")
    monkeypatch.undo()
    assert S.bm25_top(rows, none, columns, 5).count() == S.bm25_top(rows.where("tokens is null"), terms, columns, 5).count() == S.bm25_top(rows, none.limit(0), columns, 5).count() == 0


def test_categories_are_measured_over_all_points(spark, tmp_path):
    from tessella.plans.search import rank_metrics_by_category

    # Odd points of label 1, none of which is a multiple of 20, and one of label 2, whose own kind has no other.
    rows = [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(50)] + [(51, [1.0, 0.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.label: r for r in rank_metrics_by_category(spark, str(tmp_path)).collect()}
    assert {label: r.n_queries for label, r in got.items()} == {0: 25, 1: 25}
