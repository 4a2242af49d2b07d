"""Record-level operators on the supplied tables: filters, classifiers, evaluation, registers, clocks, Markdown and the tool surface."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella import api
from tessella.functions import markdown as M, text as X, times as Z
from tessella.operators import classify as C, evaluate as E, ingest as I, registers as G, reporting as R, scan as P, vector as V
from tessella.plans.registry import SQL_SCORES, Registry, sql_terms, table, titled
from tessella.plans.reporting import PORTABLE, SQL_PLANTED, _re2, planted
from tessella.plans.search import PROBE, SQL_TOP10, benchmark, judgments, labelled_hits, points, probes
from tessella.session import durable

query = Registry()


def pick(n: int, column: str, *values):
    return F.get(F.array(*map(F.lit, values)), (F.col(column) % n).cast("int"))


# -- filters and classifiers


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 5 and l_linestatus = 'O' and l_returnflag = 'A' and l_suppkey % 2 = 0")
def ready_points(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 5).alias("ready"), (F.col("l_linestatus") == "O").alias("catalog_current"), F.col("l_returnflag").alias("generation"), (F.col("l_suppkey") % 2).cast("string").alias("profile"))
    return V.ready(rows, "A", "0").select("l_orderkey", "l_linenumber")


@query("select doc_id from documents where source = 'src1' or lang = 'src1'")
def array_contains_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("source", "lang").alias("tags"), "lang")
    return V.equality_filters(rows, tags="src1", lang=None).select("doc_id")


@query("select c_custkey, case when c_custkey % 11 = 0 then 'gateway' when c_mktsegment = 'BUILDING' and c_custkey % 2 = 0 then 'native' when c_mktsegment = 'BUILDING' then 'classic' else 'none' end as style from customer")
def sidecar_styles(spark, sf_dir):
    even, none = F.col("c_custkey") % 2 == 0, F.array().cast("array<string>")
    style = C.sidecar_style(F.when(even, F.array("c_mktsegment")).otherwise(none), F.when(even, none).otherwise(F.array("c_mktsegment")), "BUILDING", F.col("c_custkey") % 11 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", style.alias("style"))


@query(
    """with r as (select o_orderkey as k, o_orderkey % 13 <> 0 as regular, o_orderkey % 11 = 0 as drifted, case o_orderkey % 4 when 0 then 'complete' when 1 then 'closed' else 'active' end as hint, case when o_orderkey % 6 = 0 then 'draft' else 'x' end as field,
 case o_orderkey % 5 when 0 then 'closed' when 1 then 'superseded' when 2 then 'odd' end as state, o_orderkey % 5 = 3 as evidence, case when o_orderkey % 17 = 0 then 'open-task' end as blocker, (epoch(timestamp '1998-08-01') - epoch(o_orderdate)) / 86400 as age, o_orderpriority as p from orders),
b as (select *, list_filter(list_sort([blocker, case when age < 0 then 'future-mtime' end, case when state not in ('closed', 'superseded') then 'terminal-state-not-allowed:' || state end, case when round(age, 3) < 30 then 'minimum-age-not-met' end, case when p = '1-URGENT' then 'canonical-authority' end, case when p = '2-HIGH' then 'git-tracked' end, case when p = '5-LOW' then 'git-tracking-unknown' end]), lambda x: x is not null) as blocks,
 list_filter([case when hint in ('closed', 'complete') then 'catalog-lifecycle-hint-only' end, case when field = 'draft' then 'closed-frontmatter-only' end], lambda x: x is not null) as reviews from r)
select k, case when not regular or drifted or (state is null and evidence) then 'blocked' when state is null and len(reviews) > 0 then 'review' when state is null then 'skip' when len(blocks) > 0 then 'blocked' else 'eligible' end as verdict,
 case when not regular then 'source-not-regular' when drifted then 'catalog-source-drift' when state is null and evidence then 'conflicting-terminal-evidence' when state is null and len(reviews) > 0 then array_to_string(reviews, ',') when state is null then 'no-terminal-evidence' when len(blocks) > 0 then array_to_string(blocks, ',') else 'strong-terminal-evidence' end as reasons from b"""
)
def quarantine_reasons(spark, sf_dir):
    k, none = F.col("o_orderkey"), F.array().cast("array<string>")
    tracking = F.when(F.col("o_orderpriority") == "2-HIGH", "tracked").when(F.col("o_orderpriority") == "5-LOW", "error").otherwise("untracked")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 13 != 0).alias("regular"), (k % 11 == 0).alias("drifted"), F.array(pick(4, "o_orderkey", "complete", "closed", "active", "active")).alias("hints"), F.array(F.when(k % 6 == 0, "draft").otherwise("x")).alias("fields"),
        pick(5, "o_orderkey", "closed", "superseded", "odd", None, None).alias("state"), F.when(k % 5 == 3, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("evidence"), F.when(k % 17 == 0, F.array(F.lit("open-task"))).alias("blockers"),
        F.col("o_orderdate").alias("mtime"), F.when(F.col("o_orderpriority") == "1-URGENT", "canonical").otherwise("working").alias("authority_class"), tracking.alias("tracking"),
    )
    out = C.quarantine(rows, key="k", now=F.lit("1998-08-01").cast("timestamp_ntz"), states=["closed", "superseded"], review_states=["complete", "draft"], least_days=30)
    return out.select("k", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query("select event_id, case when user_id % 2 = 0 and event_id % 3 <> 0 then '[redacted]' when event_id % 3 = 0 then substr(md5(props), 1, 8) else props end as args from events")
def redacted_args(spark, sf_dir):
    args = F.when(F.col("event_id") % 3 == 0, F.substring(F.md5("props"), 1, 8)).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", C.redact_args(args, F.when(F.col("user_id") % 2 == 0, "shared").otherwise("personal")).alias("args"))


SQL_RULES = "list_filter([" + ", ".join(f"case when regexp_matches(html, '{_re2(r.pattern)}') then '{r.id}' end" for r in PORTABLE) + "], lambda x: x is not null)"


@query(f"select page_id, len(l) > 0 as matched, len(l) > 0 and page_id % 2 = 0 as blocked, l[1] as first_rule from (select page_id, {SQL_RULES} as l from pages)")
def guard_decisions(spark, sf_dir):
    decision = C.guard_decision(P.matched_rules(F.col("html"), PORTABLE), F.when(F.col("page_id") % 2 == 0, "enforce").otherwise("warn"))
    return table(spark, sf_dir, "pages").select("page_id", decision.alias("d")).select("page_id", "d.*")


@query("select doc_id, unnest(" + SQL_RULES.replace("html", "text") + f") as rule_id from {SQL_PLANTED} where not contains(text, 'you are')")
def added_line_findings(spark, sf_dir):
    """Rules on lines without a waiver; documents with a planted phrase stand in for lines."""
    lines = planted(spark, sf_dir).select(F.col("doc_id").alias("path"), F.lit(1).alias("line"), "text")
    return P.added_line_lint(lines, PORTABLE, waiver="you are").select(F.col("path").alias("doc_id"), "rule_id")


@query("select o_custkey, case when count(*) filter (where o_orderstatus = 'P') > 2 then 'failed' when max(o_totalprice) > 400000 or min(o_totalprice) < 2000 then 'degraded' else 'complete' end as status from orders group by o_custkey")
def scan_generations(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))
    status = C.generation_status(F.when(F.col("p") > 3, "error"), F.when(F.col("p") == 3, 1).otherwise(0), (F.col("hi") > 400000).cast("int"), (F.col("lo") < 2000).cast("int"))
    return runs.select("o_custkey", status.alias("status"))


@query(
    """with f as (select distinct p_name as path, p_brand as term from part), r(rule, prefix, term) as (values ('r1', 'small', 'Brand#2'), ('r2', '', 'Brand#17'), ('r3', 'nothing', 'Brand#1'), ('r4', 'red', 'none'))
select 'uncovered' as kind, path || '/' || term as what from f where not exists (select 1 from r where r.term = f.term and starts_with(f.path, r.prefix)) union all select 'unused', rule from r where not exists (select 1 from f where r.term = f.term and starts_with(f.path, r.prefix))"""
)
def exemption_usage(spark, sf_dir):
    rules = spark.createDataFrame([("r1", "small", "Brand#2"), ("r2", "", "Brand#17"), ("r3", "nothing", "Brand#1"), ("r4", "red", "none")], "rule string, prefix string, term string")
    left, unused = C.exemptions(table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_brand").alias("term")).distinct(), rules)
    return left.select(F.lit("uncovered").alias("kind"), F.concat_ws("/", "path", "term").alias("what")).unionByName(unused.select(F.lit("unused").alias("kind"), F.col("rule").alias("what")))


# -- joins and merges


@query("with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) select o_custkey, o_orderkey, rank, c_mktsegment from r join customer on c_custkey = o_custkey where c_acctbal > 0 and c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def ranked_point_rows(spark, sf_dir):
    """Ranks from before the join to the rows; then only those of current revisions."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ranked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", rank.alias("rank"))
    rows = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("revision_id"))
    current = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("revision_id"))
    return I.still_current(I.point_rows(ranked, rows, "o_custkey"), current).select("o_custkey", "o_orderkey", "rank", "c_mktsegment")


@query(r"""with a(alias, needle) as (values ('./The/', 'the'), ('AND', 'and'), ('zq/zq.md', 'zq/zq.md')) select alias, doc_id from a, documents where contains(regexp_replace(lower(replace(text, '\', '/')), '(^|[\s(\["''`])\./', '\1', 'g'), needle)""")
def alias_mentions(spark, sf_dir):
    return I.alias_references(table(spark, sf_dir, "documents"), spark.createDataFrame([("./The/",), ("AND",), ("zq/zq.md",)], "alias string"), doc="doc_id", text="text")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'done' else o_orderstatus end as status, case when o_orderkey % 3 = 0 then 2 else 1 end::int as n_states, case when o_orderkey % 3 = 0 then 'done' else o_orderstatus end as last_state from orders")
def history_append(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.array(F.struct(F.col("o_orderstatus").alias("state"), F.lit(1).alias("at"))).alias("history"))
    changes = o.where("o_orderkey % 2 = 0 or o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "done").otherwise(F.col("status")).alias("status"), F.lit(2).alias("at"))
    out = I.append_history(o, changes, "o_orderkey")
    return out.select("o_orderkey", "status", F.size("history").alias("n_states"), F.element_at("history", -1)["state"].alias("last_state"))


@query(
    """with s as (select l_orderkey || '-' || l_linenumber as unit, l_orderkey as rev, sha256(l_orderkey || '|' || l_linenumber || '|' || l_quantity::int) as digest, l_linenumber, l_quantity, l_orderkey || '|' || l_linenumber || '|' || l_quantity::int as content from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_quantity)),
g as (select rev from s group by rev having rev % 5 <> 0 and not bool_or(l_quantity = 13))
select unit, rev, digest from s where (rev % 4 = 0 and l_linenumber % 2 = 0 and l_linenumber <> 6) or rev in (select rev from g)"""
)
def archive_runs(spark, sf_dir):
    """An archive that holds even lines of every fourth order, some corrupt; sources with a corrupt row, and incomplete ones, add nothing."""
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_quantity")
    lines = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(first)).where("n = 1")
    content = F.concat_ws("|", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int"))
    s = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit"), F.col("l_orderkey").alias("rev"), F.sha2(content, 256).alias("digest"), content.alias("content"), "l_linenumber", "l_quantity")
    names = ["unit", "rev", "digest", "content"]
    archived = s.where("rev % 4 = 0 and l_linenumber % 2 = 0").withColumn("content", F.when(F.col("l_linenumber") == 6, "CORRUPT").otherwise(F.col("content"))).select(names)
    source = s.withColumn("content", F.when(F.col("l_quantity") == 13, "BAD").otherwise(F.col("content"))).select(names)
    complete = s.where("rev % 5 <> 0").select("rev").distinct()
    return I.archive_backfill(archived, source, complete, "unit", "rev", "digest", "content").select("unit", "rev", "digest")


@query("select p_partkey, case when p_partkey % 3 = 0 then 'failed' else 'completed' end as status from part where p_partkey % 4 <> 0")
def checkpointed_units(spark, sf_dir):
    """Units without a checkpoint are embedded and stored; those without a vector fail."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    done = p.where("p_partkey % 4 = 0").select("p_partkey", F.lit("completed").alias("status"))
    embed = lambda d: d.where("p_partkey % 3 <> 0").withColumn("vector", F.array(F.length("p_name").cast("double")))
    return G.checkpointed_ingest(p, done, "p_partkey", embed, lambda d: d.count())


@query("select event_id, (select count(*) from orders) + row_number() over (order by event_id) as seq from events")
def sequence_log(spark, sf_dir):
    return G.append_sequence(table(spark, sf_dir, "orders"), table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("select event_id, event_type, user_id, value from events order by value desc, event_id limit 5")
def top_calls(spark, sf_dir):
    """The five largest outputs; of equal ones those that came first."""
    return R.top_calls(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value"), 5, "value", "event_id")


@query("select event_id, row_number() over (order by ts, event_id) as place from events where event_type = 'error'")
def timeline_replay(spark, sf_dir):
    """The events of one label in order, with their places."""
    records = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("observed_at"), F.col("event_type").alias("label"))
    replay = R.timeline(records, label="error")
    return R.numbered_rows(replay.withColumn("at", F.struct("observed_at", "event_id")), "at").select("event_id", (F.col("n") + 1).alias("place"))


@query("select r as real_path, min(p) as first_path, count(*) as n, string_agg(p, ',' order by p) as paths from (select distinct regexp_replace(url, '[0-9]+', 'N', 'g') as r, url || '.md' as p from pages) group by r having count(*) > 1")
def duplicate_aliases(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.concat("url", F.lit(".md")).alias("path"), F.regexp_replace("url", "[0-9]+", "N").alias("real_path"))
    return R.duplicate_aliases(files).withColumn("paths", F.array_join("paths", ","))


# -- text functions


@query(f"select item_id as query_id, nullif(array_to_string(list_transform(coalesce({sql_terms('text')}, []), lambda t: '\"' || t || '\"'), ' OR '), '') as expression from benchmark")
def match_expressions(spark, sf_dir):
    return benchmark(spark, sf_dir).select("query_id", X.match_expression(X.query_terms("text")).alias("expression"))


@query("select conv_id, turn, case when length(regexp_replace(nfc_normalize(text), '^\\s+|\\s+$', '', 'g')) between 1 and 1000 then sha256(regexp_replace(nfc_normalize(text), '^\\s+|\\s+$', '', 'g')) end as digest from conversations")
def safe_queries(spark, sf_dir):
    """The sample has no compatibility characters, so NFC says the same as NFKC; tests have both."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(X.safe_query("text"), 256).alias("digest"))


@query("""select event_id, '{"k":' || '"' || event_type || '","section":"' || user_id || '"}' as key from events""")
def cache_keys(spark, sf_dir):
    """Canonical JSON of arguments: sorted keys, without the volatile one."""
    args = F.create_map(F.lit("section"), F.col("user_id").cast("string"), F.lit("force"), F.lit("true"), F.lit("k"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.cache_key(args).alias("key"))


@query("select p_partkey, array_to_string(list_distinct_ordered, ',') as tags from (select p_partkey, case when lower(p_brand) = lower(p_type) then [lower(p_brand), 'added'] else [lower(p_brand), lower(p_type), 'added'] end as list_distinct_ordered from part)")
def tag_lists(spark, sf_dir):
    tags = F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.lit("  "), F.upper("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.normalise_tags(tags, "added"), ",").alias("tags"))


@query("select doc_id, sha256(nfc_normalize(text)) as digest from documents")
def nfkc_normalize(spark, sf_dir):
    """The sample has no compatibility characters, so NFC says the same as NFKC; tests have both."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.nfkc("text"), 256).alias("digest"))


# -- Markdown: documents whose lines take turns as headings of three levels, text and fences

SQL_MD = """md as (select doc_id, i - 1 as line, case when (i - 1) % 8 = 6 or ((i - 1) % 8 = 0 and i > 1) then '```' when i = 1 then '# ' || x || ' ##' when (i - 1) % 4 = 1 then '## ' || x when (i - 1) % 4 = 3 then '### ' || x else x end as t from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
fn as (select *, t like '```%' as fence, coalesce(sum((t like '```%')::int) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) % 2 as odd from md),
hd as (select doc_id, line, length(regexp_extract(t, '^(#+)', 1)) as level, regexp_replace(regexp_replace(regexp_extract(t, '^#{1,6}\\s+(.*)$', 1), '\\s*#*\\s*$', ''), '^\\s+|\\s+$', '', 'g') as title from fn where odd = 0 and not fence and regexp_matches(t, '^#{1,6}\\s')),
sl as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '^\\s+|\\s+$', '', 'g'), '[^a-zA-Z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') as slug from hd),
sc as (select *, (select min(b.line) from sl b where b.doc_id = sl.doc_id and b.line > sl.line and b.level <= sl.level) as until from sl)"""


def as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    def marked(x, i):
        fence = (i % 8 == 6) | ((i % 8 == 0) & (i > 0))
        return F.when(fence, "```").when(i == 0, F.concat(F.lit("# "), x, F.lit(" ##"))).when(i % 4 == 1, F.concat(F.lit("## "), x)).when(i % 4 == 3, F.concat(F.lit("### "), x)).otherwise(x)

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), marked), "\n").alias("text"))


@query(f"with {SQL_MD} select doc_id, line::int as line, level::int as level, title, slug, until::int as until from sc")
def toc_sections(spark, sf_dir):
    return M.sections(as_markdown(spark, sf_dir), id_col="doc_id", text_col="text")


@query(f"with {SQL_MD}, p as (select *, last_value(case when level = 1 then title end ignore nulls) over w as h1, last_value(case when level = 2 then title end ignore nulls) over w as h2 from hd window w as (partition by doc_id order by line rows unbounded preceding)) select doc_id, line::int as line, case level when 1 then title when 2 then h1 || ' > ' || title else h1 || ' > ' || h2 || ' > ' || title end as path from p")
def heading_stacks(spark, sf_dir):
    return M.heading_paths(as_markdown(spark, sf_dir), id_col="doc_id", text_col="text")


SQL_BODY = "(select doc_id, string_agg(t, chr(10) order by line) as body from md group by doc_id)"


@query(
    f"""with {SQL_MD}, q as (select doc_id, case doc_id % 4 when 0 then '  ' || title || ' ' when 1 then slug when 2 then title[1:5] else title[3:8] end as query from sl where line = 1),
g as (select s.*, q.query, case when lower(title) = lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) then 1 when slug = regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')), '[^a-zA-Z0-9_\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g') then 2 when starts_with(lower(title), lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g'))) then 3 when contains(lower(title), lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g'))) then 4 end as grade from sc s join q using (doc_id)),
b as (select * from g where grade is not null qualify row_number() over (partition by doc_id order by grade, line) = 1)
select b.doc_id, b.title, sha256(regexp_replace(string_agg(md.t, chr(10) order by md.line), '^\\s+|\\s+$', '', 'g')) as digest from b join md on md.doc_id = b.doc_id and md.line >= b.line and md.line < coalesce(b.until, 1 << 30) group by b.doc_id, b.title"""
)
def section_texts(spark, sf_dir):
    """Sections asked for by title, slug, the title's beginning and a part of it."""
    docs = as_markdown(spark, sf_dir)
    second = M.toc(docs, id_col="doc_id", text_col="text", least=1).where("line = 1")
    k = F.col("doc_id") % 4
    wanted = second.select("doc_id", F.when(k == 0, F.concat(F.lit("  "), "title", F.lit(" "))).when(k == 1, F.col("slug")).when(k == 2, F.substring("title", 1, 5)).otherwise(F.substring("title", 3, 6)).alias("query"))
    return M.section_text(docs, wanted, id_col="doc_id", text_col="text").select("doc_id", "title", F.sha2("text", 256).alias("digest"))


@query("select doc_id, case when doc_id % 4 = 3 then 'section' when doc_id % 4 = 2 then case when doc_id % 3 = 0 then 'toc' else 'section' end when doc_id % 4 = 1 then 'all' when doc_id % 3 <> 0 then 'section' when length(text) > 12000 then 'toc' else 'all' end as mode from (select case when true then doc_id end as doc_id, text from documents) where doc_id % 4 <> 3 or doc_id % 3 <> 0 union all select doc_id, 'toc' from documents where doc_id % 4 = 3 and doc_id % 3 = 0")
def size_policies(spark, sf_dir):
    section = F.when(F.col("doc_id") % 3 != 0, "s")
    return table(spark, sf_dir, "documents").select("doc_id", M.size_policy(F.col("text"), section, pick(4, "doc_id", "auto", "all", "section", "section")).alias("mode"))


@query(
    f"""with {SQL_MD}, b as (select doc_id, body, regexp_replace(case when contains(body, chr(10) || '##') then body[1:instr(body, chr(10) || '##') - 1] else body end, '^\\s+|\\s+$', '', 'g') as head from {SQL_BODY}), o as (select doc_id, string_agg(repeat('  ', level - 2) || '- ' || title, '|' order by line) as outline from hd where level >= 2 group by doc_id)
select b.doc_id, case when length(head) <= 800 then head else regexp_replace(head[1:800], '\\s+[^\\s]*$', '') || '…' end as lead, ceil(length(body) / 4)::bigint as tokens, coalesce(outline, '') as outline from b left join o using (doc_id)"""
)
def outline_summaries(spark, sf_dir):
    return M.outline_summary(as_markdown(spark, sf_dir), id_col="doc_id", text_col="text").withColumn("outline", F.array_join("outline", "|"))


# -- registers


SQL_CRITIQUE = "(select p_partkey, ['H', 'C', 'M', 'L'][(p_partkey % 4) + 1] || p_partkey as finding, p_name as title, ['HIGH', 'CRITICAL', 'MEDIUM', 'HIGH'][(p_partkey % 4) + 1] as severity from part)"


def critiques(spark, sf_dir) -> DataFrame:
    """A critique a part: one finding, of a wrong severity for a quarter, one quoted in a fence and one that only looks like a finding."""
    i = F.col("p_partkey").cast("string")
    lines = ["**Diff range:** a..b", "**Critic(s):** x", "**Generated:** today"]
    head = F.when(F.col("p_partkey") % 5 == 0, F.lit("\n".join(lines))).otherwise(F.lit("\n".join([*lines, "**Critique format version:** 1.0"])))
    mark = F.concat(F.lit("**"), pick(4, "p_partkey", "H", "C", "M", "L"), i, F.lit(" — "), "p_name", F.lit("** ("), pick(4, "p_partkey", "HIGH", "CRITICAL", "MEDIUM", "HIGH"), F.lit(")"))
    body = F.concat(F.lit("File: `src/a.py:"), i, F.lit("-99`\n**What:** w\n**Why it matters:** y\n**Proposed fix:** f\n**Regression-guard:** test "), i, F.when(F.col("p_partkey") % 3 == 0, "").otherwise("\n**Source critic:** safety"))
    rest = F.lit("```\n**C9 — quoted** (CRITICAL)\n```\n**H7: odd** (HIGH)\nSeverity counts: C1 H1 M0 L0")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", head, F.lit(""), mark, body, rest).alias("text"))


@query(f"select p_partkey, finding, title, severity, 'src/a.py' as file, p_partkey::int as file_line, case when p_partkey % 3 <> 0 then 'safety' end as critic, 'test ' || p_partkey as guard, case when p_partkey % 3 = 0 then 'Source critic' else '' end as lacks from {SQL_CRITIQUE}")
def critique_findings(spark, sf_dir):
    return G.critique_findings(critiques(spark, sf_dir), id_col="p_partkey", text_col="text").withColumn("lacks", F.array_join("lacks", ",")).drop("block")


@query(
    f"""select p_partkey, unnest(list_filter([case when p_partkey % 3 = 0 then finding || ' lacks Source critic' end, case when p_partkey % 4 = 3 then finding || ' has a severity of another letter' end, case when p_partkey % 5 = 0 then 'no format-version line' end, 'looks like a finding: **H7: odd** (HIGH)', 'severity counts differ from the findings'], lambda x: x is not null)) as problem from {SQL_CRITIQUE}"""
)
def critique_problems(spark, sf_dir):
    return G.critique_problems(critiques(spark, sf_dir), id_col="p_partkey", text_col="text").select("p_partkey", "problem")


@query("select p_partkey, unnest(['M' || p_partkey, 'SP' || p_partkey]) as item, unnest([p_name, p_type]) as title, unnest(['done', case when p_partkey % 2 = 0 then 'active' else 'pending' end]) as status, unnest(['milestone', 'spike']) as kind, 'E7' as epic, unnest(['now', 'later']) as lane, unnest([2, 5]) as line from part")
def roadmap_items(spark, sf_dir):
    """A roadmap a part: a milestone that a line in its section declares done, and a spike by its checkbox."""
    i = F.col("p_partkey").cast("string")
    box = F.when(F.col("p_partkey") % 2 == 0, "- [/] **SP").otherwise("- [ ] **SP")
    text = F.concat(F.lit("## Now\n### E7: Epic\n#### M"), i, F.lit(": "), "p_name", F.lit(" — Must do\n- **✅ DONE** today\n## Later\n"), box, i, F.lit(":** "), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))
    return G.roadmap_items(rows, id_col="p_partkey", text_col="t")


@query("select doc_id, case doc_id % 5 when 0 then 'closed' when 1 then 'superseded' when 2 then 'archived' end as state, doc_id % 5 = 3 as conflicting, case doc_id % 5 when 0 then 'frontmatter:closed' when 1 then 'opening-banner:superseded' when 2 then 'path-marker:archived' when 3 then 'frontmatter:closed,path-marker:done' else '' end as evidence from documents")
def terminal_states(spark, sf_dir):
    k, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    text = F.when(k.isin(0, 3), F.concat(F.lit("---\nstatus: closed\n---\n"), "text")).when(k == 1, F.concat(F.lit("> **SUPERSEDED** by x\n"), "text")).otherwise(F.col("text"))
    path = F.when(k == 2, F.concat(F.lit("archived/"), i)).when(k == 3, F.concat(F.lit("x/done-"), i)).otherwise(F.concat(F.lit("x/"), i))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("p"), text.alias("t"))
    return G.terminal_state(rows, id_col="doc_id", path_col="p", text_col="t").withColumn("evidence", F.array_join("evidence", ","))


@query(
    """select o_orderkey, unnest(list_filter([case when k = 1 then 'file-name' end, case when k = 2 then 'no-frontmatter' end, case when k = 3 then 'no-project' end, case when k = 4 then 'date-differs' end, case when k = 5 then 'no-resume-here' end, case when k = 6 then 'kind-differs' end, case when k = 6 then 'no-roadmap' end, case when k = 6 then 'no-scrutiny' end, case when k = 6 then 'no-summary' end, case when k = 7 then 'secret' end, case when k = 8 then 'other-type' end, case when k = 9 then 'unknown-kind' end, case when k = 9 then 'kind-differs' end], lambda x: x is not null)) as code from (select o_orderkey, o_orderkey % 10 as k from orders)"""
)
def handoff_findings(spark, sf_dir):
    """Ten kinds of handoff notes, each but the first with a fault of its own."""
    k = F.col("o_orderkey") % 10
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(k == 1, "notes.md").otherwise(F.concat(F.lit("HANDOFF-"), day, F.lit("-x-continuation.md")))
    meta = F.create_map(F.lit("type"), F.when(k == 8, "note").otherwise("handoff"), F.lit("project"), F.when(k == 3, "").otherwise("x"), F.lit("date"), F.when(k == 4, "1900-01-01").when(k == 1, "").otherwise(day), F.lit("handoff_kind"), F.when(k == 6, "review").when(k == 9, "other").otherwise("continuation"))
    meta = F.when(k == 1, F.create_map(F.lit("type"), F.lit("handoff"), F.lit("project"), F.lit("x"), F.lit("date"), F.lit("d"), F.lit("handoff_kind"), F.lit("continuation"))).when(k != 2, meta)
    body = F.when(k == 5, "nothing").when(k == 7, "RESUME HERE\ntoken = abcdefghijklmnop1234").otherwise("RESUME HERE")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), meta.alias("meta"), body.alias("body"))
    out = G.handoff_problems(rows, id_col="o_orderkey", name="name", meta="meta", body="body")
    return out.where(~((F.col("o_orderkey") % 10 == 1) & (F.col("code") == "date-differs")))


@query(
    """with n as (select o_custkey as case_id, lower(trim(o_orderpriority)) as name, o_orderstatus as label, row_number() over (partition by o_custkey, lower(trim(o_orderpriority)) order by o_orderpriority) > 1 as again from orders),
nv as (select case_id, sum(again::int + 2 * (label not in ('O', 'F'))::int) as v, count(*) as c from n group by 1), e as (select c_custkey as case_id, c_mktsegment as name, c_acctbal < 0 as bad from customer where c_custkey % 2 = 0)
select c.c_custkey as case_id, coalesce(nv.c, 0)::bigint as n_nodes, (e.case_id is not null)::bigint as n_facts, (coalesce(nv.v, 0) + (coalesce(nv.c, 2) not between 2 and 18)::int)::bigint as n_node_violations, (coalesce(e.bad, false)::int)::bigint as n_fact_violations,
 coalesce(nv.v, 0) + (coalesce(nv.c, 2) not between 2 and 18)::int = 0 and not coalesce(e.bad, false) and coalesce(nv.c, 0) > 0 as accepted from customer c left join nv on nv.case_id = c_custkey left join e on e.case_id = c_custkey"""
)
def extraction_audits(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("name"), F.array("o_orderstatus").alias("labels"), F.lit("g").alias("group_id"), F.lit("g").alias("expected_group"))
    edges = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_acctbal") < 0, " ").otherwise("fact").alias("fact"), F.array(F.lit(1)).alias("episodes"), F.lit(1).alias("valid_at"), F.lit("g").alias("group_id"), F.lit("g").alias("expected_group"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return G.extraction_audit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")), nodes, edges, node_kinds=["O", "F"], edge_kinds=segments)


@query("with c as (select event_type, case when avg(value) > 12 then 'degraded' else 'ok' end as state from events group by 1) select count(*) as n_components, count(*) filter (where state <> 'ok') as n_issues, coalesce(string_agg(event_type || ':' || state, ',' order by event_type) filter (where state <> 'ok'), '') as issues, count(*) filter (where state <> 'ok') = 0 as healthy from c")
def composite_health(spark, sf_dir):
    state = F.when(F.avg("value") > 12, "degraded").otherwise("ok")
    parts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("component")).agg(state.alias("state"))
    return R.composite(parts).withColumn("issues", F.array_join("issues", ","))


@query("select c_custkey, array_to_string(list_filter([case when c_acctbal < 0 then 'in-debt' end, case when c_nationkey > 20 then 'far-away' end], lambda x: x is not null), ',') as failures, c_acctbal < 0 or c_nationkey > 20 as alarm from customer")
def alarm_verdicts(spark, sf_dir):
    out = G.alarms(table(spark, sf_dir, "customer"), "c_custkey", in_debt=F.col("c_acctbal") < 0, far_away=F.col("c_nationkey") > 20)
    return out.withColumn("failures", F.array_join("failures", ","))


# -- clocks


@query("with n as (select max(ts) as now from events) select event_type, case when epoch_us(now) - epoch_us(min(ts)) > 300000000 then 'stale' else 'ok' end as state from events, n group by event_type, now")
def oldest_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    oldest = e.groupBy("event_type").agg(F.min("ts").alias("at")).crossJoin(F.broadcast(now))  # one row
    return oldest.select("event_type", Z.sla_state(F.col("at"), F.col("now")).alias("state"))


@query("select event_id, ts as at, case when event_id % 3 = 0 then ts else timestamp '2024-01-01' end as clock from events")
def clocks(spark, sf_dir):
    """Nanoseconds back to times, and a clock that only complete runs move on."""
    ts = F.col("ts").cast("timestamp")
    nanos = F.unix_micros(ts) * 1000 + 999
    rows = table(spark, sf_dir, "events").select("event_id", Z.from_nanos(nanos).alias("at"), Z.only_complete_clock(F.col("event_id") % 3 == 0, ts, F.lit("2024-01-01").cast("timestamp")).alias("clock"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "clock")})


# -- evaluation


SQL_GOLD = f"gold as (select vec_id as query_id, label as query_label, vec_id % 40 = 0 as answerable, vec_id % 60 = 0 as abstained from e where vec_id % {PROBE} = 0)"
SQL_SCORED = f"""{SQL_TOP10}, {SQL_GOLD}, res as (select * from top where rank <= 10), jd as (select q.query_id, p.vec_id as id from gold q join e p on p.label = q.query_label and p.vec_id <> q.query_id),
idl as (select query_id, sum(1 / log2(r + 1)) as idcg from (select query_id, least(10, count(*)) as n from jd group by 1), range(1, 11) t(r) where r <= n group by 1),
hits as (select r.query_id, min(rank) as first, sum(1 / log2(rank + 1)) as dcg from res r join jd on jd.query_id = r.query_id and jd.id = r.id group by 1),
slot as (select r.query_id, count(*) as hash_slots, count(*) filter (where id % 9 <> 0) as verified, count(*) filter (where not answerable and id = r.query_id + 1) as leaks, count(*) filter (where id % 7 = 0 or (not answerable and id = r.query_id + 1)) as noncurrent, count(*) filter (where id % 10 = 3) as negatives,
 bool_or(label = r.query_label and id % 9 <> 0 and id % 7 <> 0) as cited from res r join gold g on g.query_id = r.query_id group by 1),
scored as (select g.query_id, answerable, abstained, case when i.query_id is null or h.first is null then 0.0 else 1.0 end as hit, coalesce(1.0 / h.first, 0.0) as rr, coalesce(h.dcg / i.idcg, 0.0) as ndcg, coalesce(hash_slots, 0) as hash_slots, coalesce(verified, 0) as verified, coalesce(leaks, 0) as leaks, coalesce(noncurrent, 0) as noncurrent, coalesce(negatives, 0) as negatives,
 answerable <> abstained as correct, case when answerable then coalesce(cited, false) end as citation from gold g left join idl i using (query_id) left join hits h using (query_id) left join slot s using (query_id))"""


def scored(spark, sf_dir) -> DataFrame:
    """Each probe as a gold query: relevant points share its label; ids stand for revisions and paths."""
    p = points(spark, sf_dir)
    q = probes(p)
    hits = durable(labelled_hits(spark, sf_dir, 10), "hits")
    i = F.col("id")
    results = hits.select("query_id", "id", "rank", F.concat(F.lit("p"), (i % 10).cast("string")).alias("path"), i.alias("revision_id"), (i % 7 != 0).alias("current"), (i % 9 != 0).alias("source_verified"), F.lit(True).alias("span_verified"))
    truth = judgments(p, hits, 10).select("query_id", "id", F.lit(1).alias("grade"), F.concat(F.lit("p"), (i % 10).cast("string")).alias("path"), i.alias("revision_id"))
    gold = q.select("query_id", (F.col("query_id") % 40 == 0).alias("answerable"), (F.col("query_id") % 60 == 0).alias("abstained"), (F.col("query_id") + 1).alias("expected_revision"), F.array(F.lit("p3")).alias("hard_negative_paths"))
    return E.score_queries(gold, results, truth)


@query(f"with {SQL_SCORED} select query_id, answerable, abstained, hit::double as hit, round(rr, 9)::double as reciprocal_rank, round(ndcg, 9)::double as ndcg, hash_slots, verified as verified_hash_slots, leaks as historical_target_leaks, noncurrent as noncurrent_or_historical_slots, negatives as hard_negative_slots, correct as classification_correct, citation as citation_correct from scored")
def query_scores(spark, sf_dir):
    return scored(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("reciprocal_rank", "ndcg")})


@query(
    f"with {SQL_SCORED} select answerable, count(*) as n_queries, round(avg(case when answerable then hit end), 9)::double as hit_at_k, round(avg(case when answerable then rr end), 9)::double as mrr, round(avg(case when answerable then ndcg end), 9)::double as ndcg, round(avg(case when answerable then citation::int end), 9) as citation_accuracy, round(avg(case when answerable then (not abstained)::int end), 9) as acceptance, round(avg(case when not answerable then abstained::int end), 9) as negative_abstention, round(avg(correct::int), 9) as classification_accuracy, round(sum(verified) / nullif(sum(hash_slots), 0), 9) as hash_rate, sum(noncurrent)::bigint as noncurrent_slots, sum(negatives)::bigint as hard_negative_slots from scored group by answerable"
)
def macro_metrics(spark, sf_dir):
    out = E.macro_metrics(scored(spark, sf_dir), "answerable")
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c not in ("answerable", "n_queries", "noncurrent_slots", "hard_negative_slots")})


@query("with d as (select distinct round(o_totalprice, 6) as v from orders), r as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from d) select v as threshold from r where i in (0, n - 1, floor(0.1 * (n - 1)), floor(0.25 * (n - 1)), floor(0.5 * (n - 1)), floor(0.75 * (n - 1)), floor(0.9 * (n - 1))) union all select min(v) - 1e-12 from d union all select max(v) + 1e-12 from d")
def candidate_thresholds(spark, sf_dir):
    return E.candidate_thresholds(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    f"""with {SQL_SCORES}, top as (select query_id, doc_id, title, content, row_number() over (partition by query_id order by round(score, 6) desc, title, doc_id) as fusion_rank from score join d using (doc_id) qualify fusion_rank <= 30),
s as (select t.query_id, t.doc_id as id, fusion_rank, len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[^\\s]+')), list_distinct(regexp_extract_all(lower(t.content), '[^\\s]+')))) / greatest(1, len(list_distinct(regexp_extract_all(lower(b.text), '[^\\s]+')))) as share from top t join benchmark b on b.item_id = t.query_id),
c as (select *, case when fusion_rank <= 24 then row_number() over (partition by query_id, fusion_rank <= 24 order by share desc, id) end as cross_rank from s)
select query_id, id, fusion_rank, cross_rank, row_number() over (partition by query_id order by cross_rank is null, 0.75 / (60 + cross_rank) + 0.25 / (60 + fusion_rank) desc, fusion_rank, id) as final_rank from c"""
)
def rerank_blend(spark, sf_dir):
    """TF-IDF candidates reordered by a stand-in scorer: the share of the query's words that the text has."""
    from tessella.operators import search as S

    docs, queries = titled(spark, sf_dir), benchmark(spark, sf_dir)
    # A table, as the head and the whole list both read it.
    found = durable(S.tfidf_search(docs, queries, k=30).withColumnRenamed("rank", "fusion_rank").withColumnRenamed("doc_id", "id"), "found")
    rows = docs.select(F.col("doc_id").alias("id"), "content").join(S.few(found), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")

    def share(q, texts):
        words = set(q.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]

    return V.rerank(rows, share).select("query_id", "id", "fusion_rank", "cross_rank", "final_rank")


@query(
    f"""with recursive {SQL_TOP10}, t as (select query_id, id, rank, label, id % 50 as a, id % 50 + 40 as b from top where rank <= 64),
g as (select query_id, 0::bigint as rank, [] ::struct(id bigint, rank bigint, label int, a bigint, b bigint, n bigint)[] as kept from (select distinct query_id from t)
  union all select t.query_id, t.rank, case when len(list_filter(kept, lambda k: k.label = t.label and greatest(0, least(k.b, t.b) - greatest(k.a, t.a)) / (greatest(k.b, t.b) - least(k.a, t.a)) >= 0.8)) > 0
    then list_transform(kept, lambda k, i: case when i = list_position(list_transform(kept, lambda x: x.label = t.label and greatest(0, least(x.b, t.b) - greatest(x.a, t.a)) / (greatest(x.b, t.b) - least(x.a, t.a)) >= 0.8), true) then struct_pack(id := k.id, rank := k.rank, label := k.label, a := k.a, b := k.b, n := k.n + 1) else k end)
    else list_append(kept, struct_pack(id := t.id, rank := t.rank, label := t.label, a := t.a, b := t.b, n := 0::bigint)) end from g join t on t.query_id = g.query_id and t.rank = g.rank + 1),
l as (select query_id, unnest(kept) as k from g qualify rank = max(rank) over (partition by query_id))
select query_id, k.id as id, k.rank::int as rank, k.n::int as n_alternates from l"""
)
def collapse_greedy(spark, sf_dir):
    """Nearest points as spans: those of one label that overlap collapse in rank order."""
    rows = labelled_hits(spark, sf_dir).select("query_id", "id", "rank", F.col("label").cast("string").alias("revision_id"), F.sha2(F.col("id").cast("string"), 256).alias("span_sha256"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + 40).alias("end"))
    return V.collapse(rows).select("query_id", "id", "rank", F.size("alternates").alias("n_alternates"))


# -- the tool surface

#: Least scores of the answers that are given.
ANSWERED = {"exact_identifier_cross_min": 0.2, "agreement_cross_min": 0.3, "single_channel_cross_min": 0.6, "cross_margin_min": 0.02}


def word_share(q, texts):
    """A stand-in scorer: the share of the query's words that the text has."""
    words = set(q.lower().split())
    return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


def letters(text):
    """A stand-in embedding: how often each letter occurs; as a model's, it is made a batch at a time."""

    def embed(texts: pa.Array) -> pa.Array:
        one = lambda t: np.bincount(np.frombuffer(t, np.uint8), minlength=256)[97:123]
        parts = (texts.slice(i, 256).cast(pa.binary()).to_pylist() for i in range(0, len(texts), 256))
        counts = np.array([np.full(26, np.nan) if t is None else one(t) for part in parts for t in part], np.float64).reshape(-1)
        return pa.ListArray.from_arrays(np.arange(0, len(counts) + 1, 26, dtype=np.int32), pa.array(counts, from_pandas=True))

    return F.arrow_udf(embed, "array<double>")(text)


@query()
def artifact_search_full(spark, sf_dir):
    """Exact spans of all documents, searched by every benchmark text: legs, fusion, collapse, rerank, source check, cap and abstention.

    Every seventh document has a newer revision, and every eleventh one's source was changed.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = M.exact_spans(docs, id_col="doc_id", text_col="text", counter=M.word_counter)
    spans = durable(cut.select(
        F.concat_ws("/", "doc_id", "span_index").alias("span_id"), F.col("doc_id").alias("artifact_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("revision_id"), "span_sha256",
        F.col("char_start").cast("int").alias("start"), F.col("char_end").cast("int").alias("end"), F.lit(None).cast("string").alias("heading"), "content", letters(F.col("content")).alias("vector"), X.tokenize("content").alias("tokens"),
    ), "spans")
    k = F.col("doc_id")
    current = docs.select(k.alias("artifact_id"), F.concat(F.when(k % 7 == 0, "newer").otherwise("r"), k.cast("string")).alias("revision_id"), F.when(k % 11 == 0, F.concat(F.lit("!"), "text")).otherwise(F.col("text")).alias("content"))
    queries = benchmark(spark, sf_dir).select("query_id", "text", letters(F.col("text")).alias("vector"))
    results, decisions, _ = api.retrieve(spans, queries, current, scorer=word_share, policy=ANSWERED)
    return decisions.join(results.select("query_id", "rank", "id"), "query_id", "left").select("query_id", "abstained", "reason", "n_verified", "n_failed", "rank", "id")


@query("select 'catalog' as part, case when doc_id % 3 = 0 then 'plan' else 'document' end as kind, count(*) as n from documents group by 2 union all select 'checkpoint', 'vector/t/' || o_orderstatus, count(*) from orders group by 2")
def artifact_status(spark, sf_dir):
    revisions = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "plan").otherwise("document").alias("artifact_type"))
    checkpoint = table(spark, sf_dir, "orders").select(F.lit("vector").alias("sink"), F.lit("t").alias("target"), F.col("o_orderstatus").alias("status"))
    return api.artifact_status(revisions, checkpoint)


@query("select doc_id::varchar as relative_path, text[1:256] as content, length(text) > 256 as truncated, true as verified from documents where doc_id = 21")
def verified_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_sha256"))
    return api.get_artifact(docs, "21", 256)


@query("with b as (select event_type as tool, null::varchar as args, count(*) as calls, sum(k)::bigint as tokens_in, round(sum(value), 4) as tokens_out, floor(avg(value) + 0.5)::bigint as avg_ms, count(*) filter (where value < 1) as errors from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1), h as (select event_type as tool, (user_id % 7)::varchar as args, count(*) as calls, sum(k)::bigint as tokens_in, round(sum(value), 4) as tokens_out, floor(avg(value) + 0.5)::bigint as avg_ms, count(*) filter (where value < 1) as errors from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by 1, 2 order by tokens_out desc, tool, args limit 5) select * from b union all select * from h")
def token_statistics(spark, sf_dir):
    """Usage by tool, and the five calls with the largest output."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), (F.col("user_id") % 7).cast("string").alias("args"), F.get_json_object("props", "$.k").cast("long").alias("inputEst"), F.col("value").alias("outputEst"), F.col("value").alias("ms"), (F.col("value") < 1).alias("isError"))
    return api.token_stats(log, "detail").withColumn("tokens_out", F.round("tokens_out", 4))


@query("select o_orderkey::varchar as fact, o_orderdate as valid_at from orders join customer on c_custkey = o_custkey where c_mktsegment in ('BUILDING', 'MACHINERY') and contains(lower(o_orderpriority), 'high') order by case c_mktsegment when 'MACHINERY' then 1 else 2 end, o_orderdate desc nulls last, c_name, o_orderpriority, o_orderstatus, lpad(o_orderkey::varchar, 12, '0') limit 20")
def fact_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = rows.select(F.col("c_name").alias("src"), F.col("o_orderpriority").alias("rel"), F.col("o_orderstatus").alias("dst"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("fact"), F.col("c_mktsegment").alias("group_id"), F.col("o_orderdate").alias("valid_at"))
    return api.get_facts(facts, "HIGH", ["MACHINERY", "BUILDING"], 20).select(F.regexp_replace("fact", "^0+(?=.)", "").alias("fact"), "valid_at")


SQL_SPANS = "sp as (select vec_id as id, label, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm, ['t' || (vec_id % 13), 'w' || label, 'k' || (vec_id % 5)] as tokens, 'a' || (vec_id % 40) as artifact_id from embeddings)"


@query(
    f"""with {SQL_SPANS}, q as (select id as query_id, v, norm, ['t' || (id % 13), 'w' || label] as terms from sp where id % {PROBE} = 0),
vec as (select query_id, id, row_number() over (partition by query_id order by s desc, id) as rank from (select q.query_id, p.id, round(list_dot_product(q.v, p.v) / (q.norm * p.norm), 5) as s from q, sp p) qualify rank <= 64),
tf as (select id, unnest(tokens) as term from sp), nn as (select term, count(*) as n from tf group by 1), cc as (select count(*) as total from sp),
bm as (select query_id, tf.id, round(-sum((case when ln((total - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((total - n + 0.5) / (n + 0.5)) end) * 2.2 / (1 + 1.2 * (0.25 + 0.75))), 9) as bm25 from (select query_id, unnest(terms) as term from q) qt join tf using (term) join nn using (term), cc group by 1, 2),
lex as (select query_id, id, row_number() over (partition by query_id order by bm25, id) as rank from bm qualify rank <= 64),
f as (select coalesce(v.query_id, l.query_id) as query_id, coalesce(v.id, l.id) as id, coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + l.rank), 0) as s from vec v full join lex l on v.query_id = l.query_id and v.id = l.id),
u as (select query_id, id, row_number() over (partition by query_id order by round(s, 12) desc, id) as fusion_rank from f qualify fusion_rank <= 96),
c as (select u.*, artifact_id, row_number() over (partition by query_id, artifact_id order by fusion_rank) as n from u join sp using (id))
select query_id, id, fusion_rank, row_number() over (partition by query_id order by fusion_rank) as rank from c where n <= 2 qualify rank <= 10"""
)
def hybrid_search(spark, sf_dir):
    """Vector and BM25 legs, fusion, collapse (no two spans overlap here) and two spans an artifact, for all probes at once."""
    i = F.col("point_id").cast("string")
    part = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    p = points(spark, sf_dir).withColumn("t", part("t", F.col("point_id") % 13)).withColumn("w", part("w", F.col("label")))
    spans = p.select(F.col("point_id").alias("span_id"), part("a", F.col("point_id") % 40).alias("artifact_id"), i.alias("revision_id"), F.sha2(i, 256).alias("span_sha256"), F.lit(0).alias("start"), F.lit(9).alias("end"), "vector", F.array("t", "w", part("k", F.col("point_id") % 5)).alias("tokens"))
    queries = p.where(F.col("point_id") % PROBE == 0).select(F.col("point_id").alias("query_id"), F.concat_ws(" ", "t", "w").alias("text"), "vector")
    return api.search_artifacts(spans, queries).select("query_id", "id", "fusion_rank", "rank")
