"""Record-level operators on the stand-in tables: classifiers, merges, link and register checks, spans and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.functions import text as X, times as Z
from tessella.operators import classify as C, ingest as I, registers as G, reporting as R
from tessella.plans.registry import Registry, table

query = Registry()


@query("select o_orderkey, case when c_custkey is null then 'missing' when l.c_mktsegment = upper(l.c_mktsegment) and o_orderkey % 5 <> 0 then 'current' else 'stale' end as state from orders left join customer l on o_custkey = c_custkey and c_custkey % 9 <> 0")
def receipt_states(spark, sf_dir):
    """Receipts carry the segment that they saw; every fifth saw another one."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    seen = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("k")).select("o_orderkey", "k", F.when(F.col("o_orderkey") % 5 == 0, F.lower("seg")).otherwise(F.col("seg")).alias("seg"))
    return I.stale_receipts(seen, customer.where("k % 9 <> 0"), "k", "seg").select("o_orderkey", "state")


@query(
    """with a as (select c_custkey as k, c_mktsegment as s from customer where c_custkey % 3 <> 0), b as (select c_custkey as k, c_mktsegment as s from customer where c_custkey % 4 <> 0), d as (select c_custkey as k, case when c_custkey % 10 = 1 then 'OTHER' else c_mktsegment end as s from customer where c_custkey % 5 <> 0)
select k, finding from (select coalesce(a.k, b.k, d.k) as k, case when a.k is null then 'not-in-register' when b.k is null then 'not-in-document' when d.k is null then 'not-in-state' when a.s <> b.s or a.s <> d.s then 'status-differs' end as finding from a full join b on a.k = b.k full join d on coalesce(a.k, b.k) = d.k) where finding is not null"""
)
def register_reconcile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("status"))
    state = c.where("k % 5 <> 0").withColumn("status", F.when(F.col("k") % 10 == 1, "OTHER").otherwise(F.col("status")))
    return I.reconcile(c.where("k % 3 <> 0"), c.where("k % 4 <> 0"), state, "k").select("k", "finding")


@query("select p_partkey, case when p_size > 25 then upper(p_name) else p_name end as p_name from part")
def overlay_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return I.coalesce_rows(p, p.where("p_size > 25").withColumn("p_name", F.upper("p_name")), "p_partkey", "p_name")


@query("select p_partkey as k, p_name as title, case when p_partkey % 2 = 0 then p_brand else 'pending' end as status from part where p_partkey % 5 <> 0")
def structure_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"), F.col("p_brand").alias("status"))
    return I.merge_structure(p.where("k % 2 = 0"), p.where("k % 5 <> 0").withColumn("status", F.lit("pending")), "k", ["title"], ["status"])[0]


@query(
    """with f as (select url as path, regexp_extract(url, '[^/]*$') as name from pages where page_id % 2 = 0), l as (select page_id, case when page_id % 3 = 0 then url else 'x/' || regexp_extract(url, '[^/]*$') end as target from pages), n as (select name, count(distinct path) as c, min(path) as only_ from f group by name)
select page_id, case when e.path is not null then 'exact' when c = 1 then 'by-name' when c > 1 then 'ambiguous' else 'broken' end as state from l left join (select distinct path from f) e on e.path = l.target left join n on n.name = regexp_extract(l.target, '[^/]*$')"""
)
def link_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("x/"), F.substring_index("url", "/", -1))).alias("target"))
    return I.resolve_links(links, pages.where("page_id % 2 = 0").select(F.col("url").alias("path"))).select("page_id", "state")


@query("select page_id, r as reference from (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))) as r from pages) where r not in (select lower(p_name) from part) and r not in ('The', 'and', 'the')")
def broken_references(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).unionByName(spark.createDataFrame([("The",), ("and",), ("the",)], "name string"))
    return I.broken_references(table(spark, sf_dir, "pages"), targets, pattern='href="/([^"]*)"', item="page_id", text="html", name="name")


@query(
    """with p as (select c_custkey as k, c_nationkey as want, case when c_custkey % 6 = 0 then 'exclude' else 'allow' end as action from customer where c_custkey % 2 = 0), e as (select c_custkey as k, case when c_custkey % 5 = 0 then c_nationkey else c_nationkey + 1 end as have, c_acctbal > 0 as owned, c_custkey % 7 <> 0 as is_link from customer where c_custkey % 3 <> 1)
select coalesce(p.k, e.k) as k, case when want is null then case when owned then 'remove' else 'foreign' end when action = 'exclude' then case when have is null then 'refused' else 'remove' end when have is null then 'create' when not is_link then 'conflict' when have = want then case when owned then 'keep' else 'adopt' end else case when owned then 'retarget' else 'conflict' end end as bucket from p full join e on p.k = e.k"""
)
def plan_buckets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").alias("k")
    planned = c.where("c_custkey % 2 = 0").select(k, F.col("c_nationkey").alias("t"), F.when(F.col("c_custkey") % 6 == 0, "exclude").otherwise("allow").alias("action"))
    there = c.where("c_custkey % 3 <> 1").select(k, F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 1).alias("t"), (F.col("c_acctbal") > 0).alias("owned"), (F.col("c_custkey") % 7 != 0).alias("is_link"))
    return I.plan_against_existing(planned, there, "k", "t")


@query("select user_id, case when a = 'resolve' and s = 'open' then 'resolved' when a = 'replay' and s = 'open' then 'replaying' when a = 'fail' and s = 'resolved' then 'open' else s end as status, coalesce(a is not null and not ((a in ('resolve', 'replay') and s = 'open') or (a = 'fail' and s = 'resolved')), false) as refused from (select user_id, case when user_id % 2 = 0 then 'open' else 'resolved' end as s, case user_id % 4 when 0 then 'resolve' when 1 then 'fail' when 2 then 'replay' when 3 then 'resolve' end as a from (select distinct user_id from events))")
def letter_transitions(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    letters = users.withColumn("status", F.when(F.col("user_id") % 2 == 0, "open").otherwise("resolved"))
    acts = users.withColumn("action", F.get(F.array(*map(F.lit, ("resolve", "fail", "replay", "resolve"))), (F.col("user_id") % 4).cast("int")))
    return I.letter_transitions(letters, acts, "user_id").select("user_id", "status", "refused")


@query("select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderdate <= timestamp '1997-01-01' order by o_orderkey desc limit 1")
def due_job(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("complete")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("target"), status.alias("status"), F.col("o_orderdate").alias("due_at"))
    return I.due_job(jobs, F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("run_id").alias("o_orderkey"))


TAIL_SQL = """with t as (select doc_id, case when length(text) > 400 then text[-400:] else text end as t from documents), p as (select *, instr(t, chr(10)) - 1 as nl, instr(t, ' ') - 1 as sp, length(t) // 2 as half from t)
select doc_id, regexp_replace(case when nl >= 0 and nl < half then t[nl + 2:] when sp >= 0 and sp < half then t[sp + 2:] else t end, '^\\s+|\\s+$', '', 'g') as tail from p"""


@query(TAIL_SQL)
def overlap_tails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.overlap_tail("text", 400).alias("tail"))


@query("select doc_id, strlen(text[1:100])::bigint as byte_start, sha256(text[101:300]) as span_sha256, true as verified from documents where length(text) >= 300")
def span_coordinates(spark, sf_dir):
    """Characters 100 to 300 of each long document as a byte span, recorded and verified."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 300)
    rows = docs.select("doc_id", "text", X.byte_offset(F.col("text"), F.lit(100)).alias("byte_start"), X.byte_offset(F.col("text"), F.lit(300)).alias("byte_end"), F.sha2(F.substring("text", 101, 200), 256).alias("span_sha256"))
    return rows.select("doc_id", "byte_start", "span_sha256", X.span_verified(F.col("text"), F.col("byte_start"), F.col("byte_end"), F.col("span_sha256")).alias("verified"))


@query("select p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ', ,'), ','), lambda x: trim(x)), lambda x: x <> ''), '|') as members from part")
def list_coercion(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.string_or_list(F.regexp_replace("p_name", " ", ", ,")), "|").alias("members"))


@query("select page_id, regexp_replace(regexp_replace(url, '/', '/.', 'g'), '(^|/)\\.', '\\1', 'g') as path from pages")
def de_dotted_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.de_dot(F.regexp_replace("url", "/", "/.")).alias("path"))


@query("select page_id, case when n like '%handoff%' then 'handoff' when n like '%roadmap%' then 'roadmap' when regexp_matches(n, '-sp[0-9]+|-decision') then 'decision' when contains(u, '/skills/') then 'skill' when n in ('claude.md', 'agents.md', 'home.md', 'readme.md', 'index.md') then 'moc' when contains(u, '/plans/') then 'plan' else 'note' end as kind from (select page_id, u, lower(regexp_extract(u, '[^/]*$')) as n from (select page_id, case page_id % 6 when 0 then url || '/README.md' when 1 then 'x/plans/' || page_id || '.md' when 2 then 'a/HANDOFF-' || page_id || '.md' when 3 then 'k/skills/s' || page_id || '.md' when 4 then 'b/x-sp' || page_id || '.md' else url end as u from pages))")
def note_kinds(spark, sf_dir):
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 6 == 0, F.concat("url", F.lit("/README.md"))).when(F.col("page_id") % 6 == 1, F.concat(F.lit("x/plans/"), i, F.lit(".md"))).when(F.col("page_id") % 6 == 2, F.concat(F.lit("a/HANDOFF-"), i, F.lit(".md")))
    path = path.when(F.col("page_id") % 6 == 3, F.concat(F.lit("k/skills/s"), i, F.lit(".md"))).when(F.col("page_id") % 6 == 4, F.concat(F.lit("b/x-sp"), i, F.lit(".md"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", C.note_kind(path).alias("kind"))


@query(
    """with s as (select c_custkey, ['pending', 'WIP', 'shipped', 'odd', 'In-Progress'][(c_custkey % 5) + 1] as t, ['published', 'draft'][(c_custkey % 2) + 1] as i, ['verified', 'applied', 'open'][(c_custkey % 3) + 1] as o, case when c_custkey % 11 = 0 then 'superseded' else '' end as d from customer),
n as (select *, case t when 'pending' then 'pending' when 'WIP' then 'in_progress' when 'shipped' then 'complete' when 'In-Progress' then 'in_progress' else 'unknown' end as tr from s)
select c_custkey, tr as tracking, case when d = 'superseded' then 'archived-record' when i = 'published' then case when o = 'verified' then 'delivery-complete' when o = 'applied' then 'applied-not-verified' else 'code-complete-ops-open' end when tr = 'complete' then 'tracking-complete-delivery-unknown' when tr = 'in_progress' then 'active-work' when tr = 'pending' then 'planned-work' else 'state-needs-resolution' end as attention,
array_to_string(list_filter([case when tr = 'complete' and i <> 'published' then 'complete-unpublished' end, case when tr = 'unknown' then 'unknown-tracking' end], lambda x: x is not null), ',') as flags from n"""
)
def attention_states(spark, sf_dir):
    pick = lambda n, *v: F.get(F.array(*map(F.lit, v)), (F.col("c_custkey") % n).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(5, "pending", "WIP", "shipped", "odd", "In-Progress").alias("t"), pick(2, "published", "draft").alias("i"), pick(3, "verified", "applied", "open").alias("o"), F.when(F.col("c_custkey") % 11 == 0, "superseded").otherwise("").alias("d"))
    rows = rows.withColumn("tracking", C.normal_enum(F.col("t"), ["pending", "in_progress", "complete"], C.TRACKING_ALIASES))
    flags = C.flags(complete_unpublished=(F.col("tracking") == "complete") & (F.col("i") != "published"), unknown_tracking=F.col("tracking") == "unknown")
    return rows.select("c_custkey", "tracking", C.attention(F.lit(""), F.col("d"), F.col("tracking"), F.col("i"), F.col("o")).alias("attention"), F.array_join(flags, ",").alias("flags"))


@query(
    """with n as (select p_partkey, case p_partkey % 6 when 0 then p_name || '/x' when 1 then replace(p_name, ' ', '_') || '.py' when 2 then upper(replace(p_name, ' ', '_')) when 3 then 'f' || p_partkey || '(a)' when 4 then substr(md5(p_name), 1, 12) else 'x' || replace(upper(p_name[1:1]) || p_name[2:], ' ', '') end as name from part)
select p_partkey, case when trim(name) = '' then 'empty-name' when contains(name, '/') then 'path-like' when regexp_matches(name, '(?i)\\.py$') then 'file-extension' when regexp_matches(name, '^[A-Z][A-Z0-9]*_[A-Z0-9_]+$') then 'environment-key' when regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*\\([^)]*\\)$') then 'code-symbol' when regexp_matches(name, '^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$') then 'code-identifier' when regexp_matches(name, '^[0-9a-f]{7,64}$') then 'revision-hash' end as reason from n"""
)
def incidental_names(spark, sf_dir):
    k, plain = F.col("p_partkey") % 6, F.regexp_replace("p_name", " ", "_")
    name = F.when(k == 0, F.concat("p_name", F.lit("/x"))).when(k == 1, F.concat(plain, F.lit(".py"))).when(k == 2, F.upper(plain)).when(k == 3, F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit("(a)"))).when(k == 4, F.substring(F.md5("p_name"), 1, 12)).otherwise(F.regexp_replace(F.concat(F.lit("x"), F.upper(F.substring("p_name", 1, 1)), F.expr("substr(p_name, 2)")), " ", ""))
    return table(spark, sf_dir, "part").select("p_partkey", C.incidental_reason(name).alias("reason"))


@query("select event_type, count(*) as requests, count(*) filter (where value < 1) as errors, round(list_sort(list(value))[(floor((count(*) - 1) * 0.5) + 1)::bigint], 3) as p50, round(list_sort(list(value))[(floor((count(*) - 1) * 0.99) + 1)::bigint], 3) as p99 from (select * from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 500) group by event_type")
def route_metrics(spark, sf_dir):
    """Of each route's 500 most recent requests."""
    from tessella.operators import evaluate as E

    recent = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 500")
    counts = recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") < 1).alias("errors"))
    return counts.join(E.floor_index(recent, "event_type", "value", {"p50": 0.5, "p99": 0.99}), "event_type", "left")


@query("select o_orderstatus as value, 'status' as dimension, count(*) as n from orders group by 1 union all select o_orderpriority, 'priority', count(*) from orders where o_orderpriority is not null group by 1")
def outcome_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return R.one_way_counts(rows, "status", "priority").where("value is not null")


@query("select sink, status, count(*) as n from (select case when o_orderkey % 2 = 0 then 'vector' else 'graph' end as sink, o_orderstatus as status from orders) group by 1, 2")
def checkpoint_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "vector").otherwise("graph").alias("sink"), F.col("o_orderstatus").alias("status"))
    return rows.groupBy("sink", "status").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, case event_id % 4 when 0 then ts when 1 then date_trunc('second', ts) when 2 then null else date_trunc('day', ts) end as at from events")
def tolerant_times(spark, sf_dir):
    """Times as epoch numbers, ISO texts with a zone, garbage and plain dates."""
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 4 == 0, F.format_string("%.6f", F.unix_micros(ts) / 1_000_000)).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 2, "soon").otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", Z.parse_time(raw).cast("timestamp_ntz").alias("at"))


@query("select o_orderkey, o_orderdate + to_seconds((o_orderkey % 5) * 60) as next_at, case when o_orderkey % 3 = 0 then 'reopened' when timestamp '1996-01-01' >= o_orderdate then 'due' else 'open' end as review from orders")
def retry_and_review(spark, sf_dir):
    at = F.col("o_orderdate")
    deadline = F.when(F.col("o_orderkey") % 3 != 0, at.cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", Z.next_retry(at, (F.col("o_orderkey") % 5) * 60).cast("timestamp_ntz").alias("next_at"), Z.review_state(deadline, F.lit("1996-01-01").cast("timestamp")).alias("review"))


@query(
    """with n as (select o_custkey as case_id, o_orderpriority as name, o_orderstatus as label, o_custkey % 2 as g from orders), r as (select *, row_number() over (partition by case_id, lower(trim(name)) order by name, g) > 1 as again, count(*) over (partition by case_id) as c from n)
select case_id, code, count(*) as n from (select case_id, unnest(list_filter([case when again then 'duplicate-entity-name' end, case when label not in ('O', 'F') then 'entity-type' end, case when label not in ('O', 'F') then 'unexpected-entity-label' end, case when g <> 0 then 'entity-group-mismatch' end], lambda x: x is not null)) as code from r union all select distinct case_id, 'entity-count' from r where c not between 2 and 18) group by 1, 2"""
)
def node_policy(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("name"), F.array("o_orderstatus").alias("labels"), (F.col("o_custkey") % 2).cast("string").alias("group_id"), F.lit("0").alias("expected_group"))
    return G.node_violations(nodes, allowed=["O", "F"]).groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with e as (select l_orderkey as case_id, l_returnflag as name, case when l_linestatus = 'F' then '' else l_linestatus end as fact, l_quantity > 5 as has, l_discount as d from lineitem), c as (select case_id, count(*) as n from e group by 1)
select case_id, code, count(*) as n from (select case_id, unnest(list_filter([case when name not in ('A', 'N') then 'unexpected-edge-type' end, case when fact = '' then 'empty-fact' end, case when not has then 'missing-provenance' end, case when d <= 0.01 then 'missing-valid-at' end], lambda x: x is not null)) as code from e union all select case_id, 'fact-count' from c where n not between 1 and 4) group by 1, 2"""
)
def edge_policy(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("name"), F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")).alias("fact"),
        F.when(F.col("l_quantity") > 5, F.array("l_linenumber")).otherwise(F.array().cast("array<int>")).alias("episodes"), F.when(F.col("l_discount") > 0.01, F.col("l_shipdate")).alias("valid_at"), F.lit("g").alias("group_id"), F.lit("g").alias("expected_group"),
    )
    return G.edge_violations(edges, allowed=["A", "N"], most=4).groupBy("case_id", "code").agg(F.count(F.lit(1)).alias("n"))


@query("select o_custkey, count(*) filter (where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')) as n_blocking, count(*) filter (where o_orderstatus = 'O' and o_orderpriority in ('3-MEDIUM', '5-LOW')) as n_undisposed, count(*) filter (where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')) = 0 as passed from orders group by o_custkey")
def findings_gate(spark, sf_dir):
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").when(F.col("o_orderpriority") == "5-LOW", "LOW")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("finding"), severity.alias("severity"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("fixed").alias("status"))
    return G.register_gate(rows, "o_custkey").select("o_custkey", "n_blocking", F.size("undisposed").cast("long").alias("n_undisposed"), "passed")


@query("select count(*) filter (where b is not null) as n_stored, count(*) filter (where a is not null) as n_expected, count(*) filter (where b is null) as n_missing, count(*) filter (where a is null) as n_extra, count(*) filter (where a is not null and b is not null and a <> b) as n_changed, false as proven from (select x.k as a_k, x.s as a, y.s as b from (select c_custkey as k, c_mktsegment as s from customer where c_custkey % 10 <> 1) x full join (select c_custkey as k, case when c_custkey % 8 = 0 then 'X' else c_mktsegment end as s from customer where c_custkey % 10 <> 2) y on x.k = y.k)")
def vector_set_proof(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    stored = c.where("k % 10 <> 2").withColumn("s", F.when(F.col("k") % 8 == 0, "X").otherwise(F.col("s")))
    return G.vector_set_proof(stored, c.where("k % 10 <> 1"), "k", "s")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) + 0 as seq, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events qualify row_number() over (partition by user_id order by ts, event_id) > 1")
def warm_observations(spark, sf_dir):
    """Each session's observations but the first, with the change from the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("seq"), (F.col("value") - F.lag("value").over(w)).alias("delta"))
    return rows.where("seq > 1")


@query("select digest_no, user_id, count(*) as calls from (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 20 as digest_no from events) group by 1, 2")
def rolling_digests(spark, sf_dir):
    from tessella.streaming.consumer import rolling_digest_calls

    return rolling_digest_calls(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", every=20)


@query("select event_type, day, previous from (select event_type, date_trunc('day', ts) as day, sum(value) as v, case when sum(value) > 1000 then 'unhealthy' else 'healthy' end as status, lag(case when sum(value) > 1000 then 'unhealthy' else 'healthy' end) over (partition by event_type order by date_trunc('day', ts)) as previous from events group by 1, 2) where status = 'unhealthy' and (previous is null or previous <> status)")
def notifications(spark, sf_dir):
    from tessella.streaming.consumer import notify

    state = F.when(F.sum("value") > 1000, "unhealthy").otherwise("healthy")
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), F.date_trunc("day", "ts").alias("at")).agg(state.alias("status"))
    return notify(daily, F.lit(False)).select(F.col("name").alias("event_type"), F.col("at").alias("day"), "previous")


@query("select conv_id, turn, case when length(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) > 120 then regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')[1:119] || '…' else regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') end as args, substr(sha256('salt' || text), 1, 8) as hash from conversations")
def call_summaries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.args_summary("text").alias("args"), X.args_hash("text", "salt").alias("hash"))


@query("select n, count(*) as n_terms from (select term, count(distinct doc_id) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as term from documents) group by term having count(distinct doc_id) > 5) group by n")
def frequent_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0)))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 5").groupBy("n").agg(F.count(F.lit(1)).alias("n_terms"))
