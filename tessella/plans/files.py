"""Sources and sinks: files are written to the shared folder from the supplied tables and read back."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessella import schemas
from tessella.plans.registry import SQL_SCORES, Registry, table
from tessella.plans.streams import drained
from tessella.session import durable, shared_path
from tessella.sources import outbox as O, readers as S
from tessella.streaming import consumer as W

query = Registry()

#: Hash buckets of the consumers' state: a million events or so each are enough for a bucket.
FEW_BUCKETS = 8


place = shared_path


def write_files(rows: DataFrame, root: str, name: str, content: str) -> str:
    """Writes each row's content as a file of its own below root; a task that runs again writes the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        n = 0
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                full = posixpath.join(base, path)
                store.create_dir(posixpath.dirname(full), recursive=True)
                with store.open_output_stream(full, compression=None) as out:
                    out.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select(name, content).mapInArrow(write, "n long").agg(F.sum("n")).first()
    return root


def _pick(n: int, column: str, *values: str):
    return F.get(F.array(*map(F.lit, values)), (F.col(column) % n).cast("int"))


# -- policy scan

SQL_FILES = "(select ['docs', 'plans/a', 'docs/node_modules', 'src'][(page_id % 4) + 1] || '/p' || page_id || ['.md', '.TXT', '.bin'][(page_id % 3) + 1] as path, html, page_id % 4 as d, page_id % 3 as s, page_id from pages)"
SQL_OUTCOMES = f"(select *, case when d = 2 then 'pruned' when path like 'docs/%7.md' then 'excluded' when s = 2 then 'suffix' when d = 3 then 'not-included' else 'cataloged' end as outcome from {SQL_FILES})"


def _scan(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    i = F.col("page_id").cast("string")
    path = F.concat(_pick(4, "page_id", "docs", "plans/a", "docs/node_modules", "src"), F.lit("/p"), i, _pick(3, "page_id", ".md", ".TXT", ".bin"))
    root = write_files(table(spark, sf_dir, "pages").withColumn("path", path), place(spark, "scan"), "path", "html")
    return S.scan_files(spark, [root], includes=["docs/*", "plans/*"], excludes=["docs/*7.md"], prune=["node_modules"])


@query(f"select path as relative_path, strlen(html)::bigint as byte_size, sha256(html) as content_sha256, length(html)::bigint as head_chars from {SQL_OUTCOMES} where outcome = 'cataloged'")
def policy_scan(spark, sf_dir):
    """Files of the pages under a policy: globs, pruned directories, suffixes; contents of those that pass."""
    return _scan(spark, sf_dir)[0].select("relative_path", "byte_size", "content_sha256", F.length("head").cast("long").alias("head_chars"))


@query(f"select outcome, count(*) as n, sum(strlen(html))::bigint as bytes from {SQL_OUTCOMES} group by outcome")
def policy_scan_outcomes(spark, sf_dir):
    return _scan(spark, sf_dir)[1]


# -- content tiers

SQL_TIERS = "(select ['skills', 'memory', 'guides'][(item_id % 3) + 1] as tier, 'n' || item_id as name, case item_id % 3 when 0 then 'Skill ' || item_id when 1 then 'Heading ' || item_id else 'n' || item_id end as title, case when item_id % 3 = 0 then 'does ' || item_id end as description, case item_id % 3 when 0 then '---' || chr(10) || 'name: Skill ' || item_id || chr(10) || 'description: ' || chr(39) || 'does ' || item_id || chr(39) || chr(10) || '---' || chr(10) || text when 1 then '# Heading ' || item_id || chr(10) || text else text end as content from benchmark)"


def tiers(spark, sf_dir) -> DataFrame:
    """The benchmark's texts as skills, memory notes and guides, read back; a fourth tier has no directory."""
    i = F.col("item_id").cast("string")
    skill = F.concat(F.lit("---\nname: Skill "), i, F.lit("\ndescription: 'does "), i, F.lit("'\n---\n"), "text")
    k = F.col("item_id") % 3
    path = F.when(k == 0, F.concat(F.lit("skills/n"), i, F.lit("/SKILL.md"))).when(k == 1, F.concat(F.lit("memory/n"), i, F.lit(".md"))).otherwise(F.concat(F.lit("guides/n"), i, F.lit(".md")))
    content = F.when(k == 0, skill).when(k == 1, F.concat(F.lit("# Heading "), i, F.lit("\n"), "text")).otherwise(F.col("text"))
    root = write_files(table(spark, sf_dir, "benchmark").withColumn("path", path).withColumn("content", content), place(spark, "tiers"), "path", "content")
    return S.knowledge(spark, {t: f"{root}/{t}" for t in ("skills", "memory", "guides", "agents")})


@query(f"select tier, name, title, description, sha256(trim(content)) as digest from {SQL_TIERS}")
def content_tiers(spark, sf_dir):
    return tiers(spark, sf_dir).select("tier", "name", "title", "description", F.sha2("content", 256).alias("digest"))


@query(f"select coalesce(o.tier, b.tier) as tier, b.name, sha256(trim(coalesce(o.content, b.content))) as digest from {SQL_TIERS} b left join (select 'over' as tier, name, upper(name) as content from {SQL_TIERS} where tier = 'memory') o using (name)")
def tier_overlay(spark, sf_dir):
    """A later tier's rows win by name."""
    base = tiers(spark, sf_dir)
    over = base.where("tier = 'memory'").withColumn("tier", F.lit("over")).withColumn("content", F.upper("name"))
    return S.overlay(base, over).select("tier", "name", F.sha2("content", 256).alias("digest"))


@query(f"select name, title, description from {SQL_TIERS} where tier = 'skills'")
def list_skills(spark, sf_dir):
    from tessella import api

    return api.list_items(tiers(spark, sf_dir), "skills")


@query(f"select name, 'all' as mode, sha256(trim(content)) as digest from {SQL_TIERS} where tier = 'memory' and name = 'n7'")
def get_memory(spark, sf_dir):
    from tessella import api

    return api.get_item(tiers(spark, sf_dir), "memory", "N7", mode="all").select("name", "mode", F.sha2("text", 256).alias("digest"))


@query(f"select name, sha256(trim(content)) as digest from {SQL_TIERS} where tier = 'guides' and contains(name, 'n2')")
def get_guides(spark, sf_dir):
    from tessella import api

    return api.get_guides(tiers(spark, sf_dir), "N2").select("name", F.sha2("content", 256).alias("digest"))


SQL_KNOWN = SQL_SCORES.replace("from benchmark)", "from benchmark where item_id = 7)").replace("select item_id as query_id", "select 1 as query_id")
SQL_KNOWN = SQL_KNOWN.replace("d as (select doc_id, split_part(text, chr(10), 1) as title, text as content, lang from documents)", f"d as (select tier || '/' || name as doc_id, title, trim(content) as content from {SQL_TIERS})")
SQL_KNOWN = SQL_KNOWN.replace("from documents)", "from d)")


@query(f"with {SQL_KNOWN} select doc_id, score, rank from (select doc_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, title, doc_id) as rank from score join d using (doc_id)) where rank <= 10")
def search_platform_knowledge(spark, sf_dir):
    """The text of a benchmark item, searched for over all tiers."""
    from tessella import api

    text = table(spark, sf_dir, "benchmark").where("item_id = 7").select("text").first()[0]
    return api.search_knowledge(tiers(spark, sf_dir), text).select("doc_id", "score", "rank")


@query("select 'n' || item_id as name, 'section' as mode, sha256('## Part n' || item_id || chr(10) || 'of n' || item_id) as digest from benchmark where item_id = 4")
def get_agent_section(spark, sf_dir):
    """A section of an agent's note, asked for by its title; references are items of a tier like any other."""
    from tessella import api

    i = F.col("item_id").cast("string")
    content = F.concat(F.lit("# Agent n"), i, F.lit("\n\nlead\n\n## Part n"), i, F.lit("\nof n"), i, F.lit("\n\n## Other\n"), "text")
    root = write_files(table(spark, sf_dir, "benchmark").withColumn("path", F.concat(F.lit("agents/n"), i, F.lit(".md"))).withColumn("content", content), place(spark, "agents"), "path", "content")
    known = S.knowledge(spark, {"agents": f"{root}/agents"})
    return api.get_item(known, "agents", "n4", section="part n4").select("name", "mode", F.sha2("text", 256).alias("digest"))


# -- logs

SQL_LINES = "(select *, event_id % 10 as k from events)"


def _log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k = F.col("event_id") % 10
    line = F.when(k == 0, "{oops").when(k == 1, "  ").otherwise(F.to_json(F.struct("event_id", "event_type", "user_id")))
    path = place(spark, "log")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return S.json_log(spark, path, schemas.struct("event_id long, event_type string, user_id long"))


@query(f"select event_id, event_type, user_id from {SQL_LINES} where k > 1")
def json_log_rows(spark, sf_dir):
    """A JSON-lines log with malformed and blank lines."""
    return _log(spark, sf_dir)[0]


@query(f"select count(*) filter (where k > 1) as n_rows, count(*) filter (where k = 0) as n_malformed from {SQL_LINES}")
def json_log_counts(spark, sf_dir):
    return _log(spark, sf_dir)[1]


@query("select event_id, event_type from events")
def strict_log_rows(spark, sf_dir):
    """A log whose records must have all keys of the schema and no others."""
    path = place(spark, "strict")
    table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.text(path)
    return S.strict_json(spark, path, schemas.struct("event_id long, event_type string"))


@query("select event_id, case when event_id % 3 = 0 then 'extra' else '' end as unknown from events")
def closed_world_keys(spark, sf_dir):
    record = F.when(F.col("event_id") % 3 == 0, '{"k": 1, "extra": 2}').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(S.unknown_keys(record, ["k"]), ",").alias("unknown"))


@query("select event_id, case event_id % 4 when 0 then event_type || '|x' when 1 then '' end as hints from events")
def hint_arrays(spark, sf_dir):
    """Arrays of strings from JSON; null for numbers and objects."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x"]'))).when(k == 1, "[]").when(k == 2, "[1, 2]").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(S.string_array(text), "|").alias("hints"))


@query("select event_id, (event_id % 5 + 1)::int as depth, (event_id % 5 + 3)::int as nodes from events")
def json_shapes(spark, sf_dir):
    """Depth and nodes of arrays nested as deep as the id says, around three members."""
    deep = (F.col("event_id") % 5).cast("int")
    text = F.concat(F.repeat(F.lit("["), deep), F.lit('["a]", 2]'), F.repeat(F.lit("]"), deep))
    return table(spark, sf_dir, "events").select("event_id", S.json_bounds(text).alias("b")).select("event_id", "b.depth", "b.nodes")


@query("select doc_id, case when doc_id % 5 <> 0 then lang end as name, case when doc_id % 5 <> 0 then 'x y' end as tags, case when doc_id % 5 <> 0 then 2 end::int as n_keys from documents")
def frontmatter_fields(spark, sf_dir):
    """Key-value lines of a leading block; the last of equal keys wins, quotes go."""
    head = F.concat(F.lit("---\nname: "), "source", F.lit("\ntags: \"x y\"\r\nname: "), "lang", F.lit("\n---\n"), "text")
    rows = table(spark, sf_dir, "documents").withColumn("m", S.frontmatter(F.when(F.col("doc_id") % 5 != 0, head).otherwise(F.col("text"))))
    return rows.select("doc_id", F.col("m")["name"].alias("name"), F.col("m")["tags"].alias("tags"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n_keys"))


# -- outboxes and sinks


def _units(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), F.col("doc_id").cast("string").alias("unit_id"))


@query("select sha256(text) as content, doc_id::varchar as unit_id from documents")
def outbox_round_trip(spark, sf_dir):
    """Units are read only under a complete manifest whose count and digest hold."""
    path = place(spark, "outbox")
    O.write_outbox(_units(spark, sf_dir), path, "b1")
    O.write_outbox(_units(spark, sf_dir).limit(1), path, "b1")  # published already: nothing is written
    return O.read_outbox(spark, path, "b1")


@query("""with l as (select sha256('{"content":"' || sha256(text) || '","unit_id":"' || doc_id || '"}') as h from documents), b as (select h[1:4] as k, count(*) as n, sha256(string_agg(h, '' order by h)) as d from l group by 1) select 'b1' as outbox, sum(n)::bigint as n_rows, sha256(string_agg(d, '' order by k)) as digest from b""")
def outbox_manifest(spark, sf_dir):
    return O.write_outbox(_units(spark, sf_dir), place(spark, "outbox"), "b1")


@query("select p_partkey, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as p_name from part")
def upsert_sink(spark, sf_dir):
    """Two versions of a table, the second written twice."""
    p, path = table(spark, sf_dir, "part").select("p_partkey", "p_name"), place(spark, "sink")
    O.upsert_table(spark, path, p, "p_partkey", 0)
    for _ in range(2):
        out = O.upsert_table(spark, path, p.where("p_partkey % 3 = 0").withColumn("p_name", F.upper("p_name")), "p_partkey", 1)
    return out


@query("select event_id, event_type from events where epoch_us((select max(ts) from events)) - epoch_us(ts) <= 86400000000")
def cache_snapshot(spark, sf_dir):
    """A cache dumped as JSON lines and restored up to a day's age."""
    e, path = table(spark, sf_dir, "events"), place(spark, "snapshot")
    O.snapshot(e.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("cached_at")), path)
    now = e.agg(F.max("ts").cast("timestamp")).first()[0]
    return O.restore(spark, path, "event_id long, event_type string, cached_at timestamp", F.lit(now), 86400).select("event_id", "event_type")


@query("select o_orderkey, o_orderstatus from orders where o_orderkey > 1000")
def span_cursor(spark, sf_dir):
    """Rows beyond a checkpoint; the filter reaches the scan."""
    return O.after(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000)


@query("select vec_id, 2::bigint as n from embeddings where vec_id % 10 = 0")
def vector_scroll(spark, sf_dir):
    """A full scan finds the ids that come twice."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return O.scan_table(e.unionByName(e.where("vec_id % 10 = 0")), "vec_id")[1]


@query("select c_custkey, c_nationkey % 2 = 0 as same from customer")
def equal_but_volatile(spark, sf_dir):
    """Records equal but for their time stamps."""
    c = table(spark, sf_dir, "customer")
    a = F.struct("c_name", "c_nationkey", F.lit(1).alias("at"))
    b = F.struct("c_name", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 1).alias("c_nationkey"), F.lit(2).alias("at"))
    return c.select("c_custkey", a.alias("a"), b.alias("b")).select("c_custkey", O.equal_but("a", "b", ["c_name", "c_nationkey", "at"], ["at"]).alias("same"))


# -- receipts and streams


@query("select sha256(s_name) as named, case when s_suppkey % 7 = 0 then 'quarantined' else 'valid' end as state from supplier")
def receipt_scan(spark, sf_dir):
    """Receipts in shards by hash; files whose name is not their event's are set apart."""
    h = F.sha2("s_name", 256)
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit(".json")).alias("path"), F.to_json(F.struct(F.when(F.col("s_suppkey") % 7 == 0, "other").otherwise(h).alias("event_id"), F.col("s_name").alias("producer"))).alias("body"))
    root = write_files(rows, place(spark, "receipts"), "path", "body")
    valid, odd = W.receipt_stream(spark, root, schemas.RECEIPTS)
    good = drained(valid.select("event_id"), "append").select(F.col("event_id").alias("named"), F.lit("valid").alias("state"))
    return good.unionByName(drained(odd.select("named"), "append").select("named", F.lit("quarantined").alias("state")))


def _consumed(spark, sf_dir) -> W.Consumer:
    """Two batches of receipts: the second repeats every event, a seventh of them with other contents; every fifth new one is stale."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.sha2("event_type", 256).alias("digest"))
    i = F.col("event_id").cast("long")
    current = e.select("event_id", F.when(i % 5 == 0, "newer").otherwise(F.col("digest")).alias("digest"))
    c = W.Consumer(spark, place(spark, "consumer"), lambda batch, version: batch.count(), current, buckets=FEW_BUCKETS)
    c.batch(e.where(i % 2 == 0), 0)
    again = e.withColumn("digest", F.when((i % 7 == 0) & (i % 2 == 0), "changed").otherwise(F.col("digest")))
    for _ in range(2):  # a batch that runs again changes nothing
        c.batch(again, 1)
    return c


@query("select event_id::varchar as event_id, sha256(event_type) as digest, case when event_id % 5 = 0 then 'stale' else 'completed' end as status, (event_id % 2)::bigint as batch from events")
def consumer_state(spark, sf_dir):
    return _consumed(spark, sf_dir).events(1)


@query("select event_id::varchar as event_id, 'changed' as digest, 'changed-content' as reason, 1::bigint as occurrences, 1::bigint as first_batch, 1::bigint as last_batch from events where event_id % 14 = 0")
def consumer_dead_letters(spark, sf_dir):
    return _consumed(spark, sf_dir).dead_letters(1)


@query("select true as blocked, 1::bigint as intent, 0::bigint as done, count(*) filter (where event_id % 2 = 0) as n_known, (select count(*) from events where event_id % 3 = 0)::bigint as n_after, false as blocked_after from events")
def consumer_marker(spark, sf_dir):
    """The marker after a batch whose apply fails, with the events known then; and both once the batch has run again."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.sha2("event_type", 256).alias("digest"))
    i = F.col("event_id").cast("long")

    def apply(batch: DataFrame, version: int) -> None:
        if version == 1 and not mended:
            raise RuntimeError("the sink is down")

    mended: list[bool] = []
    c = W.Consumer(spark, place(spark, "consumer"), apply, buckets=FEW_BUCKETS)
    c.batch(e.where(i % 2 == 0), 0)
    try:
        c.batch(e.where(i % 3 == 0), 1)
    except RuntimeError:
        mended.append(True)
    failed = durable(c.marker().crossJoin(c.events().agg(F.count(F.lit(1)).alias("n_known"))), "marker")  # one row each
    c.batch(e.where(i % 3 == 0), 1)
    after = c.marker().select(F.col("blocked").alias("blocked_after")).crossJoin(c.events().where(i % 3 == 0).agg(F.count(F.lit(1)).alias("n_after")))  # one row each
    return failed.crossJoin(after)


@query("with a as (select *, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) >= 3600 then 1 else 0 end as new from events), b as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from a) select min(ts) as start, max(ts) + interval 1 hour as end, user_id, count(*) as n from b group by user_id, s")
def stream_session_windows(spark, sf_dir):
    """Sessions with gaps of an hour, over a stream that ends."""
    from tessella.plans.streams import event_stream

    out = drained(W.session_counts(event_stream(spark, sf_dir), "ts", "user_id", "1 hour"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


SQL_DIGESTS = """with recursive e as (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
r as (select user_id, i, ts as since, 1 as calls, 0 as digest_no, false as fired from e where i = 1
  union all select e.user_id, e.i, case when f then e.ts else since end, case when f then 0 else calls + 1 end, digest_no + f::int, f
  from (select e.user_id, e.i, e.ts, r.since, r.calls, r.digest_no, (epoch_us(e.ts) - epoch_us(r.since) >= 300 * 1000000 or r.calls + 1 >= 100) as f from r join e on e.user_id = r.user_id and e.i = r.i + 1) e)
select user_id, digest_no::bigint as digest_no, i as at_call, since as at from r where fired"""


@query(SQL_DIGESTS)
def digest_triggers(spark, sf_dir):
    """A digest at every hundredth call since the last one, or at the first call five minutes after it."""
    return W.digest_triggers(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "digest_no", "at_call", "at")
