import pytest
from pyspark.sql import functions as F

from tessella.operators import index as I, search as S

WORDS = [f"w{i}" for i in range(40)]


def corpus(spark, n, shift=0, first=0):
    """Documents whose words and lengths go by their number; every tenth has a hyphenated title."""
    rows = []
    for i in range(first, n):
        k = i + shift
        words = [WORDS[(k * j + j * j) % (5 + k % 36)] for j in range(1 + k % 23)]
        rows.append((i, ("alpha-" + WORDS[k % 7] if k % 10 == 0 else WORDS[k % 11]) + " title", " ".join(words + ["The", WORDS[k % 3].upper()]), f"s{k % 3}", "en" if k % 2 else "de"))
    return spark.createDataFrame(rows, "doc_id long, title string, content string, source string, lang string")


def asked(spark):
    texts = ["w1 w2 w2 w30", "alpha w3", "s1 en w5", "the of", "nothing here", "w0 w4 w7 w9 w11 w13"]
    return S.query_tokens(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"))


def rows(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r[2], 5)) for r in df.collect())


def compare(spark, index, docs, k=5):
    """The index's answers and those of a search that reads all documents."""
    q = asked(spark)
    queries = spark.createDataFrame(list(enumerate(["w1 w2 w2 w30", "alpha w3", "s1 en w5", "the of", "nothing here", "w0 w4 w7 w9 w11 w13"])), "query_id int, text string")
    want = rows(S.tfidf_search(docs, queries, k=k).select("query_id", "doc_id", "score", "rank"))
    assert rows(index.tfidf(q, k, "title", "doc_id", title=True)) == want and want
    from tessella.functions import text as X

    arrays = docs.select("doc_id", F.array(F.lower("source")).alias("c1"), F.array(F.lower("lang")).alias("c2"), X.tokenize("title").alias("c3"), X.tokenize("content").alias("c4"))
    scores = S.bm25_scores(arrays, q.select("query_id", "term"), list(zip(("c1", "c2", "c3", "c4"), S.BM25_WEIGHTS)), id_col="doc_id").select("query_id", F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))
    assert rows(index.bm25(q, k, "doc_id")) == rows(S.top_k(scores, k, "bm25", "doc_id").select("query_id", "doc_id", "bm25", "rank"))


@pytest.mark.parametrize("block", [4096, 7])
def test_same_rows_as_without_an_index(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "TOGETHER", 4)
    docs, path = corpus(spark, 150), f"file://{tmp_path}/index"
    I.append(docs, path, 0)
    index = I.Index(spark, path)
    assert (index.n_blocks > I.FIRST) == (block == 7)
    compare(spark, index, docs)


def test_revisions_replace_remove_and_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    first, second = corpus(spark, 60), corpus(spark, 80, shift=9, first=50)
    I.append(first, path, 0)
    I.append(second, path, 1, removed=spark.createDataFrame([(3,), (4,)], "doc_id long"))
    files = spark.read.parquet(f"{path}/postings").inputFiles()
    I.append(first, path, 1)
    assert sorted(spark.read.parquet(f"{path}/postings").inputFiles()) == sorted(files)
    live = first.where("doc_id < 50 and doc_id not in (3, 4)").unionByName(second)
    compare(spark, I.Index(spark, path), live)
    # A revision that was broken off has no row in `done` and is not read.
    first.withColumn("x", F.lit(1)).select(F.col("doc_id"), F.col("title"), F.lit(0).cast("long").alias("len")).write.parquet(f"{path}/docs/revision=2")
    assert I.Index(spark, path).docs.count() == live.count()
    I.append(corpus(spark, 1, shift=5), path, 2)
    assert I.Index(spark, path).docs.count() == live.count()


def test_blocks_below_the_kth_score_are_not_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 5)
    monkeypatch.setattr(I, "FIRST", 2)
    rows_ = [(i, "t", "rare " * 40 if i < 3 else "rare filler" if i % 4 == 0 else "filler other", "s", "en") for i in range(400)]
    docs = spark.createDataFrame(rows_, "doc_id long, title string, content string, source string, lang string")
    path = f"file://{tmp_path}/index"
    I.append(docs, path, 0)
    index = I.Index(spark, path)
    q = S.query_tokens(spark.createDataFrame([(1, "rare")], "query_id int, text string"))
    got = index.tfidf(q, 2, "doc_id").collect()
    assert [r.doc_id for r in got] == [0, 1]
    blocks = index.postings(q, 1).count()
    assert blocks > 50 and index.left.count() + I.FIRST < blocks / 10


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    I.append(corpus(spark, 80), path, 0)
    q = S.query_tokens(spark.createDataFrame([(1, "w1")], "query_id int, text string"))
    read = I.Index(spark, path).postings(q, 1)
    assert len({r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()}) == 1
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:300]


def test_empty_documents_and_tables(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", " ", None, None)], "doc_id long, title string, content string, source string, lang string")
    I.append(docs, path, 0)
    index = I.Index(spark, path)
    assert index.tfidf(asked(spark), 3, "doc_id").count() == 0 and index.bm25(asked(spark), 3, "doc_id").count() == 0
    I.append(corpus(spark, 30, first=2), path, 1)
    assert I.Index(spark, path).bm25(asked(spark), 3, "doc_id").count() > 0


def test_a_changed_table_gets_another_index(spark, tmp_path):
    table = f"file://{tmp_path}/docs"
    corpus(spark, 10).write.parquet(table)
    key = I.documents_key(spark, table)
    assert I.documents_key(spark, table) == key
    corpus(spark, 11).write.mode("append").parquet(table)
    assert I.documents_key(spark, table) != key


def test_tasks_grow_with_the_documents_and_hits_are_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 10)
    docs, path = corpus(spark, 400), f"file://{tmp_path}/index"
    assert I.blocks_of(docs, 40).rdd.getNumPartitions() == 40
    I.append(docs, path, 0)
    index, q = I.Index(spark, path), asked(spark)
    assert max(len(r.docs) for r in index.postings(q, 20).collect()) < 40
    kept = []
    met = index._met
    monkeypatch.setattr(index, "_met", lambda *a: kept.append(met(*a)) or kept[-1])
    index.tfidf(q, 5, "doc_id").collect()
    plan = kept[-1].groupBy("block", "query_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan.split("REPARTITION_BY_NUM")[0], plan
    assert kept[-1].rdd.getNumPartitions() >= index.n_blocks


def test_tokens_of_odd_texts_and_repeated_ids(spark, tmp_path):
    texts = ["Straße Kelvin İip a_b-c w1_w2\tw1 w3 x\u0000yy \U0001d400w9", "w1 W1, w1; -- - --w4 éw5éw6", None]
    docs = spark.createDataFrame([(i, (t or "").split(" ")[0] + " alpha-w3", t, "s1", None) for i, t in enumerate(texts)] + [(1, "beta-w7 w1", "w1 w9", "s2", "en")], "doc_id long, title string, content string, source string, lang string")
    path = f"file://{tmp_path}/index"
    I.append(docs, path, 0)
    from tessella.functions import text as X

    words = docs.select("doc_id", F.explode(F.concat(X.tokenize(F.coalesce("content", F.lit(""))), X.tokenize("title"), X.expand_title(X.tokenize("title")), F.array_compact(F.array(F.lower("source"), F.lower("lang"))))).alias("term"))
    got = spark.read.parquet(f"{path}/postings").where("term is not null").select(F.explode("docs.doc_id").alias("doc_id"), "term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, words.distinct().collect()))
    counts = docs.select("doc_id", F.explode(X.tokenize("content")).alias("term")).groupBy("doc_id", "term").count()
    tf = spark.read.parquet(f"{path}/postings").where("term is not null").select("term", F.explode("docs").alias("d")).where("d.tf > 0").select("d.doc_id", "term", "d.tf")
    assert sorted(map(tuple, tf.collect())) == sorted(map(tuple, counts.collect()))
