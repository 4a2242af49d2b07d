"""Catalog, ingest, retention and classification queries on the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import ids
from tessella.operators import classify as C, ingest as I
from tessella.operators.substrings import contains_pairs
from tessella.plans.registry import Registry, table

query = Registry()


# Runs are order months, complete unless July; observations are lines; revisions are parts.
SQL_RUNS = """runs as (select (year(o_orderdate) * 100 + month(o_orderdate))::bigint as run_id, case when month(o_orderdate) = 7 then 'failed' else 'complete' end as status, max(o_orderdate) as finished_at from orders group by 1, 2),
obs as (select distinct (year(o_orderdate) * 100 + month(o_orderdate))::bigint as run_id, l_partkey as revision_id from orders join lineitem on l_orderkey = o_orderkey)"""


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.month("o_orderdate") == 7, "failed").otherwise("complete")
    r = orders.groupBy(month.alias("run_id"), status.alias("status")).agg(F.max("o_orderdate").alias("finished_at"))
    obs = orders.select("o_orderkey", month.alias("run_id")).join(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("revision_id")), F.col("o_orderkey") == F.col("l_orderkey"))
    return r, obs.select("run_id", "revision_id").distinct()


@query(f"with {SQL_RUNS} select p_partkey as revision_id, p_brand, p_size from part where p_partkey in (select revision_id from obs where run_id = (select max(run_id) from runs where status = 'complete'))")
def current_revisions(spark, sf_dir):
    r, obs = runs(spark, sf_dir)
    revisions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("revision_id"), "p_brand", "p_size")
    return I.current_revisions(revisions, obs, r)


@query(f"with {SQL_RUNS} select revision_id, min(run_id) as first_seen, max(run_id) as last_seen from obs group by revision_id")
def revision_history(spark, sf_dir):
    return I.upsert_history(runs(spark, sf_dir)[1], "revision_id", "run_id")


@query(f"with {SQL_RUNS} select status, count(*) as n_runs, max(run_id) as newest from runs group by status")
def run_status_counts(spark, sf_dir):
    return runs(spark, sf_dir)[0].groupBy("status").agg(F.count(F.lit(1)).alias("n_runs"), F.max("run_id").alias("newest"))


@query("select sha256(text) as digest, count(distinct doc_id) as n_items, sum(strlen(text))::bigint as total_bytes from documents group by text having count(distinct doc_id) > 1")
def duplicate_content(spark, sf_dir):
    return I.duplicate_content(table(spark, sf_dir, "documents"), digest=F.sha2("text", 256), item="doc_id", size=F.octet_length("text").cast("long"))


@query("select sha256(text) as digest, count(distinct source) as n_sources, count(*) as n_rows from documents group by text having count(distinct source) > 1")
def hash_dupes_across_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_rows")).where("n_sources > 1")


NS = ids.UNIT_NAMESPACE.hex
SQL_UUID = f"sha1(unhex('{NS}') || encode(revision_id || chr(0) || doc_id || chr(0) || content))"


@query(
    f"""with a as (select doc_id, 'artifact:' || sha256('{ids.ARTIFACT_NAMESPACE}' || chr(92) || '0' || source || '/' || doc_id) as artifact_id, sha256(text) as content from documents),
r as (select *, 'revision:' || sha256(artifact_id || chr(92) || '0' || content) as revision_id from a), u as (select *, {SQL_UUID} as h from r)
select doc_id, artifact_id, revision_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(('0x' || h[17:17])::int % 4) + 1] || h[18:20] || '-' || h[21:32] as unit_id from u"""
)
def content_hash_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.artifact_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("artifact_id"), F.sha2("text", 256).alias("content"))
    named = docs.withColumn("revision_id", ids.revision_id(F.col("artifact_id"), F.col("content")))
    return named.withColumn("unit_id", ids.unit_id(F.col("revision_id"), F.col("doc_id"), F.col("content"))).drop("content")


@query("with l as (select sha256(text) as h from documents), b as (select h[1:4] as k, count(*) as n, sha256(string_agg(h, '' order by h)) as d from l group by 1) select sum(n)::bigint as n_rows, sha256(string_agg(d, '' order by k)) as digest from b")
def set_digest(spark, sf_dir):
    return ids.bucketed_digest(table(spark, sf_dir, "documents"), F.sha2("text", 256))


SQL_PATH = "(select page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) as path from pages)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("path"))


@query(
    f"""select page_id, case when contains(p, 'handoff') then 'handoff' when contains(p, 'roadmap') then 'roadmap' when contains(p, 'milestone') or contains(p, '.claude/notes/') then 'milestone_evidence'
when contains(p, '/adr/') or contains(p, 'decision') then 'decision' when contains(p, 'research') or contains(p, 'spike') or contains(p, 'investigation') then 'research' when contains('/' || p, '/plans/') then 'plan' else 'document' end as artifact_type,
case when starts_with(path, 'plans/') then 'workspace_plans' when starts_with(path, 'docs/') then 'workspace_docs' when starts_with(path, 'repos/') then 'gitlab_workspace' else 'workspace' end as source_scope,
case when contains(p, 'archive') then 'archived' else 'active' end as hints from (select *, lower(path) as p from {SQL_PATH})"""
)
def path_classify(spark, sf_dir):
    rows = paths(spark, sf_dir).withColumn("kind", C.artifact_kind(F.col("path"))).withColumn("scope", C.scope_and_project(F.col("path")))
    hints = C.lifecycle_hints(F.col("path"), F.lit(""), F.col("kind.artifact_type"))
    return rows.select("page_id", F.col("kind.artifact_type").alias("artifact_type"), F.col("scope.source_scope").alias("source_scope"), F.array_join(hints, ",").alias("hints"))


SQL_HEADS = f"(select page_id, case when page_id % 3 = 0 then 'docs/handoff/' else '' end || path as path, case page_id % 5 when 0 then 'status: closed ' when 1 then 'this was SUPERSEDED by ' when 2 then 'Verdict: pending ' when 3 then 'status: complete, superseded ' else '' end || html as head from {SQL_PATH} join (select page_id, html from pages) using (page_id))"


@query(
    f"""select page_id, case when len(l) = 0 then 'active' else array_to_string(list_sort(l), ',') end as hints from (select page_id, list_filter([case when contains(lower(path), 'archive') then 'archived' end,
case when contains(lower(path), 'supersed') or contains(lower(head), 'superseded') then 'superseded' end, case when contains(lower(head), 'status: closed') or contains(lower(head), 'status: complete') then 'closed' end,
case when contains(lower(path), 'handoff') and (contains(lower(head), 'status: requested') or contains(lower(head), 'review: requested') or contains(lower(head), 'verdict: pending')) then 'review_open' end], lambda x: x is not null) as l from {SQL_HEADS})"""
)
def head_hints(spark, sf_dir):
    """Lifecycle hints from the heads of texts, as well as from paths."""
    k = F.col("page_id") % 5
    head = F.concat(F.when(k == 0, "status: closed ").when(k == 1, "this was SUPERSEDED by ").when(k == 2, "Verdict: pending ").when(k == 3, "status: complete, superseded ").otherwise(""), "html")
    rows = paths(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", F.lower(head).alias("head")), "page_id")
    rows = rows.withColumn("path", F.concat(F.when(F.col("page_id") % 3 == 0, "docs/handoff/").otherwise(""), "path"))
    kind = C.artifact_kind(F.col("path"))["artifact_type"]
    return rows.select("page_id", F.array_join(C.lifecycle_hints(F.col("path"), F.col("head"), kind), ",").alias("hints"))


@query(f"select page_id, case when rtrim(path, '/') like '%7' then 'exclude' when path like '%a%' then 'allow' else 'deny' end as action, case when rtrim(path, '/') like '%7' then 'x1' when path like '%a%' then 'a1' else 'default' end as rule from {SQL_PATH}")
def first_match_policy(spark, sf_dir):
    policy = C.first_match_policy(F.col("path"), [("x1", "*7")], [("a1", "*a*")])
    return paths(spark, sf_dir).select("page_id", policy.alias("p")).select("page_id", "p.action", "p.rule")


@query("with u as (select o_orderkey from orders order by o_orderkey limit 500) select o_orderkey from u where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def pending_units(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return I.pending(orders.select("o_orderkey"), orders.where("o_orderstatus = 'F'"), "o_orderkey", limit=500)


@query("with m as (select user_id, ts, event_id from events where user_id not in (select o_custkey from orders where o_totalprice > 300000)) select user_id, count(*) as n_events, min(ts) as oldest, arg_min(event_id, struct_pack(ts := ts, event_id := event_id)) as oldest_event from m group by user_id")
def unobserved_events(spark, sf_dir):
    events, seen = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("user_id")).distinct()
    return events.join(seen, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("oldest"), F.min_by("event_id", F.struct("ts", "event_id")).alias("oldest_event"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'O') and c_custkey not in (select o_custkey from orders where o_totalprice > 400000) and c_custkey not in (select s_suppkey from supplier)")
def irreproducible_set(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_custkey").alias("c_custkey")
    frozen, current = orders.where("o_orderstatus = 'O'").select(key), orders.where("o_totalprice > 400000").select(key)
    return I.minus(table(spark, sf_dir, "customer"), "c_custkey", frozen, current, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey")))


@query(
    """with h as (select o_orderkey, o_orderdate + interval 60 day as checked, l_shipdate, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where l_shipdate <= o_orderdate + interval 60 day)
select o_orderkey, checked, max(l_shipdate) as shipped, arg_max(l_linenumber, struct_pack(l_shipdate := l_shipdate, l_linenumber := l_linenumber)) as line, count(*) filter (where l_shipdate = m) > 1 as ambiguous from (select *, max(l_shipdate) over (partition by o_orderkey) as m from h) group by o_orderkey, checked"""
)
def asof_selection(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") + F.expr("interval 60 days")).alias("checked"))
    versions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("shipped"), F.col("l_linenumber").alias("line"))
    return I.as_of(points, versions, "o_orderkey", "checked", "shipped")


@query(
    """with l as (select p_partkey as k from part where p_partkey % 7 <> 0), r as (select distinct l_partkey as k from lineitem where l_quantity > 10), j as (select l.k as a, r.k as b from l full join r on l.k = r.k)
select count(*) filter (where a is not null and b is not null) as n_both, count(*) filter (where b is null) as n_only_left, count(*) filter (where a is null) as n_only_right,
(select coalesce(string_agg(k, ',' order by k), '') from (select a as k from j where b is null order by a limit 20)) as only_left, (select coalesce(string_agg(k, ',' order by k), '') from (select b as k from j where a is null order by b limit 20)) as only_right from j"""
)
def set_parity(spark, sf_dir):
    left = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_partkey").alias("k"))
    out = I.set_parity(left, right, "k")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("n_both", "n_only_left", "n_only_right", text("sample_only_left").alias("only_left"), text("sample_only_right").alias("only_right"))


@query("with s as (select distinct l_partkey as k from lineitem where l_quantity >= 3), n as (select distinct l_orderkey, l_partkey from lineitem) select l_orderkey, count(*) as n_needed, count(k) as n_had, count(*) = count(k) as covered from n left join s on k = l_partkey group by l_orderkey")
def coverage_division(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return I.covered(lines, lines.where("l_quantity >= 3"), "l_orderkey", "l_partkey")


@query(
    """with f as (select c.c_custkey, c_mktsegment <> 'MACHINERY' as complete, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O') as bound, case when c_acctbal < 0 then null else c_acctbal > 8000 end as irr, c_nationkey < 5 as named, c_acctbal from customer c)
select case when not complete or bound or irr is null or irr then 'retain' when named then 'retain-by-default' else 'prunable' end as verdict, count(*) as n, round(sum(c_acctbal), 2) as total from f group by 1"""
)
def retention_verdict(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("bound")).distinct()
    rows = table(spark, sf_dir, "customer").join(open_, "c_custkey", "left")
    irreproducible = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") > 8000)
    verdict = C.retention_verdict(F.col("c_mktsegment") != "MACHINERY", F.coalesce("bound", F.lit(False)), irreproducible, F.col("c_nationkey") < 5)
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("select o_orderkey, o_orderstatus = 'O' as ready, o_orderkey in (select l_orderkey from lineitem where l_quantity > 25) as set_to from orders where (o_orderstatus = 'O') <> (o_orderkey in (select l_orderkey from lineitem where l_quantity > 25))")
def lifecycle_diff(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("ready"))
    current = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.lifecycle_plan(points, current, "o_orderkey", "ready")


@query("select user_id, count(*) as occurrences, min(ts) as first_seen, max(ts) as last_seen, arg_max(props, struct_pack(ts := ts, props := props)) as last_reason from events where event_type = 'error' group by user_id")
def dead_letter_rollup(spark, sf_dir):
    return I.dead_letters(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "ts", "props")


@query("select o_orderkey, case when o_orderkey < max(o_orderkey) over (partition by o_custkey) and o_orderstatus in ('O', 'P') then 'superseded' when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'P' then 'failed' else 'complete' end as status from orders")
def reconcile_supersede(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "failed").otherwise("complete")
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", status.alias("status"))
    return I.supersede(jobs, "o_custkey", "o_orderkey", "status").select("o_orderkey", "status")


@query(
    """with s as (select event_type, date_trunc('day', ts) as day, case when sum(value) > 1000 then 'unhealthy' else 'healthy' end as state from events group by 1, 2)
select event_type, day, state, previous from (select *, lag(state) over (partition by event_type order by day) as previous from s) where state is distinct from previous"""
)
def alert_transitions(spark, sf_dir):
    state = F.when(F.sum("value") > 1000, "unhealthy").otherwise("healthy")
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(state.alias("state"))
    return I.transitions(daily, "event_type", "day", "state")


@query("select user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) as action from events group by user_id")
def last_action_wins(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("place"), F.col("event_type").alias("action"))
    return I.last_action(log, "user_id", "place", "action")


@query("select o_orderkey, o_orderpriority <> '1-URGENT' and row_number() over (partition by o_custkey, o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey desc) > 5 as rotate from orders")
def newest_n_keep(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return I.newest_n(orders, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"), keep=5, protected=F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "rotate")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def inventory_completeness(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return I.minus(table(spark, sf_dir, "part"), "p_partkey", shipped)


@query("select regexp_replace(url, '[0-9]+', 'N', 'g') as address, min(page_id) as page_id from pages group by 1")
def first_seen_dedupe(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("address", F.regexp_replace("url", "[0-9]+", "N"))
    return pages.groupBy("address").agg(F.min("page_id").alias("page_id"))


@query("select item_id as needle_id, doc_id from benchmark, documents where contains(documents.text, benchmark.text)")
def backlink_search(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return I.backlinks(table(spark, sf_dir, "documents"), needles, doc="doc_id", text="text")


@query(
    """with o(owner, signal, place) as (values ('alpha', 'th', 1), ('beta', 'en', 2), ('gamma', 'the', 3), ('delta', 'ou', 4))
select doc_id, arg_min(owner, struct_pack(at := instr(lower(text), signal), l := -length(signal), place := place)) as owner from documents, o where contains(lower(text), signal) group by doc_id"""
)
def owner_resolution(spark, sf_dir):
    owners = spark.createDataFrame([("alpha", "th", 1), ("beta", "en", 2), ("gamma", "the", 3), ("delta", "ou", 4)], "owner string, signal string, place int")
    return I.resolve_owner(table(spark, sf_dir, "documents"), owners, item="doc_id", text="text")


SQL_NAMES = "(select distinct p_name as name, regexp_replace(lower(trim(p_name)), '[\\s-]+', '-', 'g') as key from part)"
SQL_ASKED = "(select distinct n_name as query, regexp_replace(lower(trim(n_name)), '[\\s-]+', '-', 'g') as key from nation union select distinct upper(p_name), regexp_replace(lower(trim(p_name)), '[\\s-]+', '-', 'g') from part union select distinct substr(p_name, 2), regexp_replace(lower(trim(substr(p_name, 2))), '[\\s-]+', '-', 'g') from part)"


@query(
    f"""with n as {SQL_NAMES}, a as {SQL_ASKED}, e as (select query, min(name) as name from a join n using (key) group by query), s as (select query, count(*) as c, min(name) as name from a join n on contains(n.key, a.key) group by query having count(*) = 1)
select a.query, coalesce(e.name, s.name) as name, case when e.name is not null then 'exact' when s.name is not null then 'unique-substring' else 'none' end as kind from a left join e using (query) left join s using (query)"""
)
def name_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query"))
    asked = asked.unionByName(part.select(F.upper("p_name").alias("query"))).unionByName(part.select(F.expr("substr(p_name, 2)").alias("query")))
    return C.name_lookup(part.select(F.col("p_name").alias("name")), asked)


@query("select p_partkey, n_nationkey from part, nation where contains(lower(p_brand), n_nationkey::varchar) or contains(lower(n_name), lower(p_brand))")
def topic_match(spark, sf_dir):
    """Either side contains the other."""
    topics = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("long"), F.col("n_nationkey").cast("string").alias("t"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("q"))
    held = contains_pairs(parts, topics.select(F.col("n_nationkey").alias("needle_id"), F.col("t").alias("needle")), doc="p_partkey", text="q").select("p_partkey", F.col("needle_id").alias("n_nationkey"))
    holds = contains_pairs(topics, parts.select(F.col("p_partkey").alias("needle_id"), F.col("q").alias("needle")), doc="n_nationkey", text="long").select(F.col("needle_id").alias("p_partkey"), "n_nationkey")
    return held.unionByName(holds).distinct()
