"""Text, ids, times and Markdown functions."""

import hashlib
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from tessella.functions import ids, markdown as M, text as X, times as Z


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_tokenize(spark):
    assert one(spark, X.tokenize("t"), t="The AUTO_PASSTHROUGH of Keycloak, a-b x 42!") == ["auto-passthrough", "keycloak", "a-b", "42"]
    assert len(X.STOP_WORDS) == len(set(X.STOP_WORDS)) == 126
    assert one(spark, X.expand_title(F.array(F.lit("a-beta"), F.lit("x")))) == ["a-beta", "x", "beta"]


def test_query_terms(spark):
    assert one(spark, X.query_terms("t"), t="How is the Foo.bar:baz foo.bar:baz of x_1 /etc") == ["foo.bar:baz", "x_1", "etc"]
    assert len(one(spark, X.query_terms("t"), t=" ".join(f"w{i}" for i in range(100)))) == 64
    assert one(spark, X.match_expression(F.array(F.lit("a"), F.lit('b"c')))) == '"a" OR "b""c"'
    assert one(spark, X.identifiers("t"), t="abc ab-1 plain x.y/z abc1 ab-1") == ["ab-1", "x.y/z", "abc1"]


def test_names(spark):
    assert one(spark, X.canonical_name("t"), t="  My  Great-- Skill ") == "my-great-skill"
    assert one(spark, X.slug("t"), t="What's new, in v2.0?") == "whats-new-in-v20"
    assert one(spark, X.slug_plain("t"), t=" What's new? ") == "what-s-new"
    assert one(spark, X.de_dot("t"), t=".claude/.x/y.z") == "claude/x/y.z"


@pytest.mark.parametrize("line,state", [("- [x] M1", "done"), ("- [/] M1", "active"), ("- [ ] DONE", "pending"), ("## M2 ✅", "done"), ("M3 in progress", "active"), ("M4", "pending")])
def test_status(spark, line, state):
    assert one(spark, X.status_of_line("t"), t=line) == state


def test_ids_in_backticks(spark):
    assert one(spark, X.backtick_id("t"), t="see `m6i.large` `plan-m3b-x` `y-spike-2`") == "M3b"
    assert one(spark, X.backtick_id("t"), t="`y-spike-2`") == "SP2" and one(spark, X.backtick_id("t"), t="none `m6id`") is None


def test_semantic_title(spark):
    assert one(spark, X.semantic_title("t"), t="← E3: Gateway cutover — Must do. RICE = 4") == "Gateway cutover"
    assert one(spark, X.semantic_title("t"), t="") == "untitled"


def test_log_fields(spark):
    assert one(spark, X.args_summary("t"), t=" a \n b ") == "a b"
    assert len(one(spark, X.args_summary("t"), t="x" * 300)) == 120
    assert one(spark, X.args_hash("t", "salt"), t="a") == hashlib.sha256(b"salta").hexdigest()[:8]
    assert one(spark, X.token_estimate("t"), t="abcde") == 2
    assert one(spark, X.cache_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("force"), F.lit("x")))) == '{"a":"1","b":"2"}'
    assert one(spark, X.string_or_list("t"), t=" a, ,b ") == ["a", "b"]
    assert one(spark, X.normalise_tags(F.array(F.lit(" A "), F.lit("a"), F.lit("")), "type/x")) == ["a", "type/x"]


def test_nfkc_and_scan_text(spark):
    t = "ｆｕｌｌ​ width\n\n x"
    assert one(spark, X.nfkc(F.col("t")), t=t) == unicodedata.normalize("NFKC", t)
    assert one(spark, X.scan_text("t"), t=t) == "full width x"
    assert one(spark, X.safe_query("t"), t="  ok ") == "ok" and one(spark, X.safe_query("t"), t="x" * 1001) is None


def test_ids(spark):
    name = "revision:1\x000\x00ab"
    assert one(spark, ids.uuid5(ids.UNIT_NAMESPACE, F.col("t")), t=name) == str(uuid.uuid5(ids.UNIT_NAMESPACE, name))
    for i in range(40):
        assert one(spark, ids.uuid5(ids.UNIT_NAMESPACE, F.col("t")), t=str(i)) == str(uuid.uuid5(ids.UNIT_NAMESPACE, str(i)))
    assert one(spark, ids.artifact_id(F.col("t")), t="a/b") == "artifact:" + hashlib.sha256((ids.ARTIFACT_NAMESPACE + "\\0a/b").encode()).hexdigest()
    assert one(spark, ids.group_namespace(F.col("t"), "p"), t="A b/c") == "p_a_b_c_" + hashlib.sha256(b"A b/c").hexdigest()[:10]


def test_set_digest_ignores_order(spark):
    df = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    a = ids.bucketed_digest(df, F.col("h")).first()
    assert a == ids.bucketed_digest(df.orderBy(F.desc("h")).repartition(7), F.col("h")).first() and a.n_rows == 100


def test_offsets_and_spans(spark):
    t = "é🎉x\r\ny"
    assert one(spark, X.byte_offset(F.col("t"), F.lit(2)), t=t) == len("é🎉".encode())
    body = t.encode()[2:7]
    check = lambda h: one(spark, X.span_verified(F.col("t"), F.lit(2), F.lit(7), F.lit(h)), t=t)
    assert check(hashlib.sha256(body).hexdigest()) and not check("00")


def test_times(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    assert [one(spark, Z.parse_time(F.lit(s)).isNotNull()) for s in ("1700000000", "2026-01-01T00:00:00Z", "2026-01-01 00:00", "never", "")] == [True, True, True, False, False]
    assert one(spark, Z.age_seconds(at("2026-01-03"), now)) == 0.0 and one(spark, Z.age_hours(at("2026-01-01"), now)) == 24.0
    assert [one(spark, Z.expiry_level(x, now)) for x in (at("2026-01-01"), at("2026-01-10"), at("2026-03-01"), F.lit(None).cast("timestamp"))] == ["expired", "expiring-soon", "ok", "unparseable"]
    assert [one(spark, Z.rpo_status(x, now)) for x in (at("2026-01-01 01:00"), at("2025-12-01"), F.lit(None).cast("timestamp"))] == ["within", "breach", "never"]
    assert one(spark, Z.review_state(at("2026-01-02"), now)) == "due" and one(spark, Z.sla_state(at("2026-01-01"), now)) == "stale"
    assert str(one(spark, Z.from_nanos(F.lit(1_700_000_000_123_456_789)))).startswith("2023-11-14") and one(spark, Z.only_complete_clock(F.lit(False), now, at("2025-01-01"))).year == 2025
    assert one(spark, Z.next_retry(now, F.lit(60.0))).minute == 1


MD = "# Top\n\nintro\n\n## One\n\ntext\n\n```\n# not a heading\n```\n\n### Deep dive ##\n\nmore\n\n## Two\n\nend\n"


def md(spark):
    return spark.createDataFrame([(1, MD)], "id int, text string")


def test_outline(spark):
    got = [(r.level, r.title, r.slug) for r in M.toc(md(spark), id_col="id", text_col="text").orderBy("line").collect()]
    assert got == [(2, "One", "one"), (3, "Deep dive", "deep-dive"), (2, "Two", "two")]
    until = {r.title: r.until for r in M.sections(md(spark), id_col="id", text_col="text").collect()}
    assert until["One"] == until["Deep dive"] == 16 and until["Two"] is None and until["Top"] is None
    wanted = spark.createDataFrame([(1, "deep")], "id int, query string")
    assert M.section_text(md(spark), wanted, id_col="id", text_col="text").first().text == "### Deep dive ##\n\nmore"
    paths = {r.path for r in M.heading_paths(md(spark), id_col="id", text_col="text").collect()}
    assert paths == {"Top", "Top > One", "Top > One > Deep dive", "Top > Two"}
    s = M.outline_summary(md(spark), id_col="id", text_col="text").first()
    assert s.outline == ["- One", "  - Deep dive", "- Two"] and s.lead.startswith("# Top")


def test_chunks():
    long = "word " * 2400
    got = M.chunks(MD + "\n" + long, 600, 100)
    text = lambda s: "".join(s.split())
    assert text("".join(c for _, _, c, _ in got)) == text(MD + long)
    assert all(len(c) <= 600 for _, _, c, _ in got) and got[0][3] == ""
    assert all(before and got[i][2].endswith(before) for i, before in ((k, c[3]) for k, c in zip(range(len(got)), got[1:])))
    assert M.chunks("", 600, 100) == [] and M.chunks(MD, 5000, 400)[0][1] == "Top > Two"
    with pytest.raises(ValueError):
        M.chunks("x", 100, 10)


def test_exact_spans(spark):
    text = MD + "\r\n" + "é 🎉 " * 300 + "\nlast line"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = M.exact_spans(df, id_col="id", text_col="text", counter=M.word_counter, most=50, overlap=10).collect()
    count = M.word_counter()
    for r in rows:
        assert text[r.char_start : r.char_end] == r.content and text.encode()[r.byte_start : r.byte_end].decode() == r.content
        assert count(r.content) <= 50 and hashlib.sha256(r.content.encode()).hexdigest() == r.span_sha256
    seen = set()
    for r in rows:
        seen |= set(range(r.char_start, r.char_end))
    assert all(i in seen or text[i].isspace() for i in range(len(text)))


def test_overlap_tail_is_the_cutters(spark):
    for t in ("", "short", "x" * 50, "aa bb " + "c" * 30, "line\n" + "d" * 30, "e" * 30 + " f"):
        assert (one(spark, X.overlap_tail("t", 20), t=t) or "") == M.tail(t, 20)


def test_tables_left_behind_are_removed(spark, tmp_path):
    from tessella import session

    session.clean()
    before = session.shared_path(spark, "x")
    table = session.durable(spark.range(3), "left")
    assert table.count() == 3 and session.clean() == 1 and session.clean() == 0 and not session._made and before


def test_texts_are_normalised_a_part_at_a_time(spark):
    import unicodedata

    import pyarrow as pa

    from tessella.operators import scan as P
    from tessella.session import text_slices

    texts = ["plain " * 200_000, None, "ﬁne Ａ " * 200_000, "é" * 5, "", "é"]
    a = pa.array(texts)
    assert len(list(text_slices(pa.record_batch([a], ["t"]), 0))) > 1
    assert X.normalised(a).to_pylist() == [t and unicodedata.normalize("NFKC", t) for t in texts] and X.normalised(a.slice(0, 0)).to_pylist() == []
    plain = pa.array(["abc", None])
    assert X.normalised(plain).buffers()[2].address == plain.buffers()[2].address
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.n for r in df.select("i", X.nfkc("t").alias("n")).collect()} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    P.safety_scan(df, id_col="i", text_col="t")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16m"


def test_tokens_are_extracted_as_texts_are_split(spark):
    rows = spark.createDataFrame([("A_b-c  x yy\u00c9z9 -- the 42! \u0130a\n",), ("a" * 300_000 + " b",), ("",), (None,)], "t string")
    split = F.filter(F.split(X.token_text("t"), " "), X.is_token)
    assert rows.where(~X.tokenize("t").eqNullSafe(split)).count() == 0
    # No blank is put in for what stands between tokens.
    assert "regexp_replace" not in rows.select(X.tokenize("t"))._jdf.queryExecution().executedPlan().toString()
