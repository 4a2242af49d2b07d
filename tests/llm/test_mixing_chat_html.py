"""Mixing budgets by a brute-force water filling, chat masks by round trips, page layout by fixtures, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import catalog, chat, htmltext, mixing


# -- mixing


def brute_fill(budget, children):
    """children: (capacity, weight) -> shares, by handing out what is left until nothing changes."""
    share = [0.0] * len(children)
    left, open_ = budget, set(range(len(children)))
    while left > 1e-9 and open_:
        w = sum(children[i][1] for i in open_)
        full = {i for i in open_ if share[i] + left * children[i][1] / w >= children[i][0] - 1e-12}
        if not full:
            for i in open_:
                share[i] += left * children[i][1] / w
            break
        for i in full:
            left -= children[i][0] - share[i]
            share[i] = children[i][0]
        open_ -= full
        # The others start again from what is left.
        for i in open_:
            left += share[i]
            share[i] = 0.0
    return share


def brute_mix(rows, weights, total, epochs, seed):
    """rows: (id, levels, tokens) -> copies by row."""
    caps = defaultdict(float)
    for _, levels, t in rows:
        for d in range(len(levels) + 1):
            caps[levels[:d]] += t * epochs
    budget = {(): total}
    names = list(weights)
    for depth, name in enumerate(names):
        for parent in [k for k in list(budget) if len(k) == depth]:
            kids = sorted(k for k in caps if len(k) == depth + 1 and k[:depth] == parent)
            for k, s in zip(kids, brute_fill(budget[parent], [(caps[k], weights[name].get(k[-1], 1.0)) for k in kids])):
                budget[k] = s
    copies = [0] * len(rows)
    leaves = defaultdict(list)
    for i, (_, levels, _) in enumerate(rows):
        leaves[levels].append(i)
    for leaf, members in leaves.items():
        tokens = sum(rows[i][2] for i in members)
        b = int(budget[leaf] + 1e-6)
        whole = min(epochs, b // tokens) if tokens else epochs
        for i in members:
            copies[i] = whole
        if whole < epochs:
            rest, upto = b - whole * tokens, 0
            key = lambda i: (hashlib.sha256(f"{seed}|{whole}|{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:16], rows[i][0] is not None, rows[i][0] or 0)
            groups = defaultdict(list)
            for i in members:
                groups[key(i)].append(i)
            for k in sorted(groups):
                upto += sum(rows[i][2] for i in groups[k])
                if upto > rest:
                    break
                for i in groups[k]:
                    copies[i] += 1
    return copies


@pytest.mark.parametrize("share,epochs,seed", [(0.3, 1, 1), (0.8, 2, 2), (1.0, 1, 3), (2.0, 2, 4), (5.0, 3, 5), (0.0, 1, 6)])
def test_mixing(spark, share, epochs, seed):
    rng = random.Random(seed)
    rows = [(i, ("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.choice(["en", "de", "none"]), rng.choice("xyz")), rng.choice([0, 1, 5, 40, 300])) for i in range(600)]
    rows += [rows[5], rows[5], (None, ("a", "en", "x"), 7)]
    weights = {"domain": {"hot": 1.0, "a": 3.0}, "lang": {"en": 4.0, "de": 0.5}, "source": {}}
    df = spark.createDataFrame([(i, d, None if l == "none" else l, s, t, "t") for i, (d, l, s), t in rows], "doc_id long, domain string, lang string, source string, tokens long, bucket string")
    out = mixing.mix_sources(df, {"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}, weights, F.col("tokens"), share=share, epochs=epochs, seed=seed)
    got = sorted(((r.doc_id, r.mix_domain, r.mix_lang, r.mix_source, r.mix_tokens, r.mix_copies) for r in out.collect()), key=repr)
    total = sum(t for _, _, t in rows) * share
    want = sorted(((i, *levels, t, c) for (i, levels, t), c in zip(rows, brute_mix(rows, weights, total, epochs, seed))), key=repr)
    assert got == want
    assert sum(g[4] * g[5] for g in got) <= total + 1e-6


def test_mixing_clashing_columns_and_narrow_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    names = ["whole", "partial", "rest", "key", "bucket", "cut", "tokens", "budget", "digits", "n_rows", "left", "at"]
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), *(F.lit(7).alias(n) for n in names))
    out = mixing.mix_sources(df, {"source": F.col("source")}, {}, F.lit(3), share=0.5, seed=4)
    assert out.columns == [*df.columns, "mix_source", "mix_tokens", "mix_copies"]
    rows = [(i, (str(i % 3),), 3) for i in range(300)]
    assert {r.doc_id: r.mix_copies for r in out.collect()} == dict(enumerate(brute_mix(rows, {"source": {}}, 450.0, 1, 4)))
    with pytest.raises(ValueError):
        mixing.mix_sources(df.withColumn("mix_tokens", F.lit(1)), {"source": F.col("source")}, {}, F.lit(3))


def test_mixing_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(df, {"source": F.col("source")}, {}, F.length("text")).collect() == []


def test_siblings_come_before_ancestors(spark):
    rows = [(1, "d1", "x", 10), (2, "d1", "y", 1000), (3, "d2", "z", 1000)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, source string, tokens long")
    leaves = df.groupBy("domain", "source").agg(F.sum("tokens").alias("tokens"))
    got = {(r.domain, r.source): r.budget for r in mixing.budgets(leaves, ["domain", "source"], {}, 400.0, 1).collect()}
    assert got == {("d1", "x"): 10, ("d1", "y"): 190, ("d2", "z"): 200}


# -- chat


TEXTS = ["", " ", "\n\n x", "x <", "|", "<|im_end|>", "<|im_start|>assistant<|im_sep|>", "<\\|", "<\\\\|im_sep|>", "a<|endoftext|>b", "é日本 🎉", "<" * 5 + "|", "tail \n", "\\", "<\\", "x" * 20_000]


def test_escapes_round_trip():
    for t in TEXTS:
        e = chat.escape(t)
        assert chat.unescape(e) == t and "<|" not in e
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\ab") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t
        assert chat.parse(chat.render([(t, t), ("assistant", t)])[0]) == [(t, t), ("assistant", t)]


def test_mask_is_the_interval_test():
    rng = random.Random(1)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 10))
        spans = list(zip(cuts[::2], cuts[1::2]))
        tokens = [(a, a + rng.randrange(0, 4)) for a in sorted(rng.sample(range(60), 15))]
        got = chat.mask(np.array([a for a, _ in tokens]), np.array([b for _, b in tokens]), spans)
        assert got.tolist() == [any(s <= a and b <= e for s, e in spans) and b > a for a, b in tokens]
    assert chat.mask(np.array([0, 3]), np.array([3, 5]), []).tolist() == [False, False]


def test_formatting(spark):
    rows = []
    for k in range(40):
        rng = random.Random(k)
        rows += [(k, t, rng.choice(["user", "assistant", "system", None, "assist<|im_sep|>"]), rng.choice([*TEXTS, None])) for t in range(rng.randrange(1, 9))]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (None, 0, "assistant", "none"), (7, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn if turn is not None else -1, role or "", text or "", role is not None, text is not None))
    made = {r.conv_id: r for r in chat.format_chats(df, catalog.tokenizer_path(catalog.BYTES)).collect()}
    assert set(made) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, r, t, _, _ in sorted(turns, key=lambda x: (x[0], x[3], x[1], x[4], x[2]))]
        m = made[c]
        assert chat.parse(m.formatted) == turns and m.n_turns == len(turns)
        loss = chat.masked_texts(m.formatted, np.array(m.starts), np.array(m.ends), np.array(m.loss_mask))
        assert loss == [t for r, t in turns if r == "assistant" and t]
    assert chat.format_chats(df.limit(0), catalog.tokenizer_path(catalog.BYTES)).collect() == []


def test_chat_query(spark, sf_dir, duck):
    df = catalog.op1_chat_formatting(spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()["op1_chat_formatting"])
    assert df.columns == [c[0] for c in want.description]
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want.fetchall())
    assert got[0][0] == -1


# -- pages


PAGES = [
    ("", ""),
    ("plain &amp; <b>bold</b>  text", "plain & bold text"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<div>a<div>b</div></div>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
    ("<table><tr><th>name<th>n<tr><td>apple<td>10<tr><td>fig</td><td>7</td></table>", "name  | n\napple | 10\nfig   | 7"),
    ("<table><tr><td colspan=2>wide<td>c</tr><tr><td>a<td>b<td>d</table>", "wide  | c\na | b | d"),
    ("<table><tr><td>layout only</td></tr></table>", "layout only"),
    ("<script>var x = '<p>no</p>';</script>yes<style>p{}</style><noscript>n</noscript>", "yes"),
    ("<p hidden>no</p><p style='display: none'>no</p><p style=\"visibility:hidden\">no</p>yes", "yes"),
    ("<p aria-hidden=true>shown</p><p style='display:none;display:block'>too</p><p style='display:none !important; display:block'>no</p><p style='DISPLAY:block;display:none'>no</p>", "shown\n\ntoo"),
    ("<p style='visibility:hidden;visibility:visible'>a</p><p style='visibility:visible; visibility : hidden'>no</p>", "a"),
    ("<table><caption>cap<tr><td>1<td>2</table>", "cap\n1 | 2"),
    ("<table><caption>cap<td>1<td>2</table>", "cap\n1 | 2"),
    ("<a href=it's>link</a> <a title=\"a>b\" x='c>d' y>two</a> <a = b>three</a><a href=/x/>four</a>", "link two threefour"),
    ("before<a title=\"x>text</a>", "before"),
    ("before<p class='y>text</p>", "before"),
    ("<ol reversed><li>a<li>b<li value=7>c<li>d</ol>", "4. a\n3. b\n7. c\n6. d"),
    ("<ol start=3><li>a<li value=x>b<li value=-2>c<li>d</ol><ul><li value=9>e</ul>", "3. a\n4. b\n-2. c\n-1. d\n\n- e"),
    ("<template><p>no</p></template><!-- no -->a<!-- <p>no -->b", "ab"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>  x\n    y\n</pre>z", "  x\n    y\n\nz"),
    ("<a href='a>b'>link</a> &lt;tag&gt; &#x41;&nbsp;B", "link <tag> A B"),
    ("<h1>T</h1>text<h2>U</h2>more", "T\n\ntext\n\nU\n\nmore"),
    ("<select><option>a<option selected>b<option>c</select><select multiple><option>d<option>e</select><select><option>first<option>no</select>", "b d e first"),
    ("x<input type=submit value=Send><input value=typed><input type=hidden value=no><input type=password value=no><input placeholder=hint><textarea>\n&lt;a&gt;\n b</textarea>y", "x Send typed hint <a>\n b y"),
    ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<ul style='visibility:hidden'><li>no<li style='visibility:visible'>item</ul>", "yes\n\n- item"),
    ("<div style='display:none'><b style='visibility:visible;display:block'>no</b></div>ok", "ok"),
    ("<details><summary>more</summary>no</details><details open><summary>s</summary>body</details>", "more\ns\nbody"),
    ("<details>no</details>ok", "ok"),
    ("a<pre>\nb\n\nc</pre>d", "a\n\nb\n\nc\n\nd"),
    ("a<pre>\r\n\r\nb</pre>", "a\n\n\nb"),
    ("<table><tr><td rowspan=2>r<td>a<td>b<tr><td>c<td>d<tr><td>e<td>f<td>g</table>", "r | a | b\n  | c | d\ne | f | g"),
    ("<table><tr><td>a<td rowspan=3 colspan=2>big<td>z<tr><td>b<td>y<tr><td>c</table>", "a | big | z\nb |     | y\nc"),
    ("<table><tr><td colspan=99999999>w<td>x<tr><td>a<td>b</table>", "w     | x\na | b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
    ("<p>unclosed <i>it<p>next</i> x", "unclosed it\n\nnext x"),
    ("</p></div>stray", "stray"),
    ("text < 5 and > 3", "text < 5 and > 3"),
    ("<!DOCTYPE html><html><head><title>no</title></head><body>yes</body></html>", "yes"),
    ("<title>a</title", ""),
    ("<script>never closed", ""),
    ("<!-- never closed", ""),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_render(html, want):
    assert htmltext.render(html) == want


def test_render_survives_odd_pages():
    assert htmltext.render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert "x" in htmltext.render("<ul><li>" * 300 + "x")
    assert "x" in htmltext.render("<table><tr><td>" * 200 + "x")
    assert htmltext.render("<ul><li>" * 60 + "x") == "- " * 60 + "x"
    nested = htmltext.render("<table><tr><td>" * 50 + "in" + "<td>side</table>" * 50)
    assert nested.startswith("in | side") and nested.count("side") == 50


def test_text_stays_in_proportion_to_the_page():
    """Alignment and indentation never take more than the page's padding; beyond it all text is still there."""
    pages = [
        "<table><tr>" + f"<td>{'w' * 300}" * 40 + "<tr><td>a<td>b" * 500 + "</table>",
        "<table><tr>" + "<td rowspan=65534>c" * 900 + "<tr><td>x" * 900 + "</table>",
        "<table><tr>" + "<td colspan=1000>c" * 900 + "</table>",
        "<ul><li>" * 500 + "<li>y" * 3000,
        "<table><tr><td>k<td>" * 400 + "<br>z" * 2000,
    ]
    for page in pages:
        text = htmltext.render(page)
        assert len(text) <= (htmltext.PADDING + 4) * len(page) + htmltext.LEAST_PADDING
        words = re.sub(r"<[^>]*>", " ", page).split()
        assert sorted(re.sub(r"(?m)^[ -]+| \| |\|", " ", text).split()) == sorted(words)
    rng = random.Random(2)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<ul>", "<li>", "</ul>", "<b", ">", "\"", "'", "<!--", "-->", "&amp", "&#0;", "w", " ", "<pre>", "\n", "<br/>", "</", "<script>", "</script>"]
    for _ in range(500):
        htmltext.render("".join(rng.choice(bits) for _ in range(60)))


def test_all_visible_words_are_there(spark, sf_dir):
    """Against a plain strip of tags, scripts and styles: the same words in the same order."""
    import html as H

    for r in htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect():
        bare = re.sub(r"(?is)<!--.*?-->|<(script|style|title|head)\b.*?</\1>", "", r.html)
        words = H.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", bare)).split()
        got = re.sub(r"(?m)^\s*(?:- |\d+\. )| \| ", " ", r.text).split()
        assert "".join(got) == "".join(w for w in words if w != "|") or "".join(got).replace("|", "") == "".join(words).replace("|", "")


def test_extract_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (None, "<p>x", "t"), (2, "", "t")], "page_id long, html string, text string")
    assert sorted(map(tuple, htmltext.extract(df).collect()), key=repr) == [(1, ""), (2, ""), (2, ""), (None, "x")]
    assert htmltext.extract(df.limit(0)).collect() == []


def test_stray_table_text_and_foreign_content():
    for part in ("thead", "tbody", "tfoot"):
        assert htmltext.render(f"<table><{part}>Note<tr><td>1</table>") == "Note\n1"
    assert htmltext.render("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds") == "so x=1 holds"
    drawn = "<svg><title>t</title><desc>d</desc><defs><text>q</text></defs><metadata>m</metadata><defs/><text>Jan</text><text>Feb</text></svg>"
    assert htmltext.render(f"{drawn}<desc>shown</desc>") == "Jan\nFeb\nshown"
