"""Each stage against brute force on its own input, and the whole run."""

import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_dedup import brute_components  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    out = [("documents", spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    for name, f in corpus_pipeline.STAGES:
        f(spark, out[-1][1], sf_dir).write.parquet(f"{base}/{name}")
        out.append((name, spark.read.parquet(f"{base}/{name}")))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns


def test_language_stage(stages, spark):
    """The classifier by plain sums of log-probabilities: texts without a letter and sure contradictions go."""
    import numpy as np

    from tessella.llm import langid

    before, after = stages[0][1], stages[1][1]
    model = langid.fit(before.where(~langid.held_out("doc_id")))
    want = {}
    for r in before.collect():
        if any(c.isalpha() for c in r.text or ""):
            s = model.log_prior + model.log_prob[langid.grams(r.text)].astype(np.float64).sum(axis=0)
            p = np.exp(s - s.max())
            best = model.languages[int(p.argmax())]
            if not (r.lang in model.languages and best != r.lang and p.max() / p.sum() >= corpus_pipeline.CONFIDENT):
                want[r.doc_id] = r.lang or best
    assert {r.doc_id: r.lang for r in after.collect()} == want and len(want) >= 0.99 * before.count()


def test_language_stage_decides(spark, sf_dir):
    """A mislabelled text goes, an unlabelled one gets its language, and without any label all texts with a letter stay."""
    en, de = "the cat and the dog are in the house ", "der hund und die katze sind in dem haus "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(60)] + [(100, en * 9, "de"), (101, de * 9, None), (102, "12 34", "en"), (103, None, "en"), (None, en * 9, "en"), (104, en, "xx")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "p", 0.5) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    out = corpus_pipeline.language_id(spark, docs.where("lang <> 'xx' or lang is null"), sf_dir)
    assert out.columns == docs.columns
    got = {r.doc_id: r.lang for r in out.collect()}
    assert got == {**{i: lang for i, _, lang in rows[:60]}, 101: "de", None: "en"}
    bare = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert sorted(r.doc_id for r in bare.where("doc_id is not null").collect()) == [*range(60), 100, 101, 104] and {r.lang for r in bare.collect()} == {None}


def test_exact_stage(stages):
    keep = {}
    for r in stages[1][1].collect():
        keep[r.text] = max(keep.get(r.text, -1), r.doc_id)
    assert ids(stages[2][1]) == sorted(keep.values())


def test_near_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2][1].collect()]
    assert ids(stages[3][1]) == sorted({c for _, _, c in brute_components(rows)})


def test_mixing_stage(stages):
    before, after = stages[3][1].collect(), stages[4][1].collect()
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len({r.doc_id for r in after}) == len(after)
    assert 0.7 * words(before) < words(after) <= 0.9 * words(before)


def test_packing_stage(stages):
    spans, fill = defaultdict(list), defaultdict(int)
    for r in stages[5][1].collect():
        spans[r.doc_id].append((r.start, r.length, r.doc_tokens))
        fill[r.sequence_id] += r.length
    assert sorted(spans) == ids(stages[4][1]) and max(fill.values()) <= 2048
    for parts in spans.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]


def test_run_is_the_stages(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages[-1][1])


def test_repeated_rows_and_empty_tables(spark, sf_dir):
    rows = [(1, "same text here", "en", "s", 1), (1, "same text here", "en", "s", 1), (2, None, "en", "s", 0), (3, "other words", None, None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    assert ids(corpus_pipeline.exact_dedup(spark, docs, sf_dir)) == [1, 2, 3]
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf_dir).count() == 0


def test_exact_stage_keeps_every_text(spark, sf_dir):
    rows = [(None, "copied"), (1, "copied"), (None, "only here"), (5, "A"), (5, "B"), (7, "B"), (8, None), (8, ""), (9, "same"), (9, "same"), (None, "nulls"), (None, "nulls")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.exact_dedup(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted([(1, "copied"), (None, "only here"), (5, "A"), (7, "B"), (8, ""), (9, "same"), (None, "nulls")], key=repr)


def test_near_stage_keeps_every_text(spark, sf_dir):
    """Ids that are null or stand for several texts: of each group of near copies one row stays, and no other text is lost."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (None, c), (None, "lonely words only here"), (None, c + " more"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, row string")
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert set(left) <= set(rows) and len(left) == len(set(left)) == 6
    assert {(1, a), (3, b + " more"), (None, "lonely words only here"), (4, None), (5, "")} <= set(left)
    assert sum(t in (c, c + " more") for _, t in left) == 1


def test_stages_carry_other_columns(spark, sf_dir):
    """Nulls in any column, a very long text, repeated rows and columns named like the operators' own go through all stages."""
    names = ["__id", "row", "first", "kept", "n", "mix_tokens", "mix_copies", "whole", "lang_pred", "score", "component_id", "key", "start", "ids"]
    texts = [("word%d " % i) * 3 + "some more text that is its own %d" % (i * 7) for i in range(30)] + ["long%d " % 1 + " ".join(str(k) for k in range(200_000)), None, ""]
    rows = [(i if i != 4 else None, t, "en" if i % 3 else None, "src1" if i % 4 else None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(3).alias(c) for c in names))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.count() > 0 and (name == "packing" or docs.columns == columns)


def test_stages_with_ids_of_text(spark, sf_dir):
    """Ids of another type, null and repeated: no stage fails or loses a text."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [("1", a), ("2", a + " more"), ("x", b), (None, b + " more"), (None, "lonely words only here"), ("2", "other words altogether in this row")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id string, text string, lang string, source string, n_chars long")
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert {("1", a), (None, "lonely words only here"), ("2", "other words altogether in this row")} <= left and len(left) == 4
    assert sum(t in (b, b + " more") for _, t in left) == 1
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() > 0


def test_exact_stage_of_rows_that_differ_elsewhere(spark, sf_dir):
    """The same row stays however the rows are dealt."""
    rows = [(1, "t", "en", "s2", 5), (1, "t", "en", "s1", 5), (1, "t", "de", "s9", 5)]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        assert [(r.lang, r.source) for r in corpus_pipeline.exact_dedup(spark, docs, sf_dir).collect()] == [("de", "s9")]
