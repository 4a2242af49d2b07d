"""Registers kept in Markdown and JSON: critiques, roadmaps, handoffs, extraction policies and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions import text as X
from tessella.operators.classify import incidental_reason
from tessella.operators.reporting import numbered_rows, violations

# Severities by the letter of a finding's id; fields that a finding must have; header lines of a critique.
SEVERITIES = {"C": "CRITICAL", "H": "HIGH", "M": "MEDIUM", "L": "LOW"}
FIELDS = ("What", "Why it matters", "Proposed fix", "Regression-guard", "Source critic")
HEADERS = {"diff-range": r"(?m)^\*\*Diff range:\*\*", "critic": r"(?m)^\*\*Critic(\(s\))?:\*\*", "generated": r"(?m)^\*\*Generated:\*\*", "format-version": r"(?m)^\*\*Critique format version:\*\*\s*1\.0\s*$"}
FINDING = r"^\*\*([A-Z]?-?[CHML]\d+)\s*(?:—|-+)\s*(.+?)\*\*\s*\(([A-Z]+)\)\s*$"
SUSPICIOUS = r"^\*\*[A-Z]?-?[CHML]\d+\b|^\*\*.*\*\*\s*\((CRITICAL|HIGH|MEDIUM|LOW)\)\s*$"


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 0), text and fenced of every line."""
    lines = df.select(F.col(id_col), F.posexplode(F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")).alias("line", "text"))
    fence = F.col("text").rlike(r"^\s*(```|~~~)")
    before = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("fenced", fence | (F.coalesce(F.sum(fence.cast("int")).over(before), F.lit(0)) % 2 == 1))


def critique_findings(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, finding, title, severity, file, file_line, critic, guard and the fields it lacks, of each finding block outside fences."""
    lines = lines_of(df, id_col, text_col).where("not fenced")
    head = F.col("text").rlike(FINDING)
    block = F.sum(head.cast("int")).over(Window.partitionBy(id_col).orderBy("line"))
    joined = lines.withColumn("block", block).where("block > 0").groupBy(id_col, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("body"))
    part = lambda i: F.regexp_extract("body", "(?m)" + FINDING, i)
    cited = F.regexp_extract(F.regexp_extract("body", r"(?m)^File:\s*(.*)$", 1), "`([^`]+)`", 1)
    place = r"^(.*?):(\d+)(?:[-,][0-9,\-\s]*)?$"
    lacks = F.array_compact(F.array(F.when(~F.col("body").rlike(r"(?m)^File:"), "File"), *(F.when(~F.col("body").rlike(rf"(?m)^\*\*{f}:\*\*"), f) for f in FIELDS)))
    blank = lambda c: F.when(c != "", c)
    return joined.select(
        id_col,
        "block",
        part(1).alias("finding"),
        F.trim(part(2)).alias("title"),
        part(3).alias("severity"),
        blank(F.when(cited.rlike(place), F.regexp_extract(cited, place, 1)).otherwise(cited)).alias("file"),
        F.when(cited.rlike(place), F.regexp_extract(cited, place, 2).cast("int")).alias("file_line"),
        blank(F.regexp_extract("body", r"(?m)^\*\*Source critic:\*\*\s*([\w\-]+)", 1)).alias("critic"),
        blank(F.trim(F.regexp_extract("body", r"(?m)^\*\*Regression-guard:\*\*\s*(.+)$", 1))).alias("guard"),
        lacks.alias("lacks"),
    )


def critique_problems(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id and problem: every way in which a critique departs from its format."""
    text = F.col(text_col)
    found = critique_findings(df, id_col=id_col, text_col=text_col)
    letter = F.regexp_extract("finding", r"([CHML])\d+$", 1)
    expected = F
    for k, v in SEVERITIES.items():
        expected = expected.when(letter == k, v)
    known = F.col("severity").isin(list(SEVERITIES.values()))
    blocks = found.select(id_col, F.explode(F.concat(F.transform("lacks", lambda f: F.concat(F.col("finding"), F.lit(" lacks "), f)), F.array_compact(F.array(F.when(~known, F.concat("finding", F.lit(" has an unknown severity"))), F.when(known & (expected.otherwise(F.lit(None)) != F.col("severity")), F.concat("finding", F.lit(" has a severity of another letter"))))))).alias("problem"))
    twice = found.groupBy(id_col, "finding").count().where("count > 1").select(id_col, F.concat("finding", F.lit(" is given twice")).alias("problem"))
    heads = df.select(id_col, F.explode(F.array_compact(F.array(*(F.when(~text.rlike(p), F.lit(f"no {n} line")) for n, p in HEADERS.items())))).alias("problem"))
    near = lines_of(df, id_col, text_col).where(~F.col("fenced") & F.col("text").rlike(SUSPICIOUS) & ~F.col("text").rlike(FINDING)).select(id_col, F.concat(F.lit("looks like a finding: "), F.substring(F.trim("text"), 1, 80)).alias("problem"))
    counted = r"Severity counts:\*{0,2}\s*(?:[A-Z]-)?C(\d+)\s+(?:[A-Z]-)?H(\d+)\s+(?:[A-Z]-)?M(\d+)\s+(?:[A-Z]-)?L(\d+)"
    said = df.select(id_col, *(F.regexp_extract(text, counted, i + 1).try_cast("int").alias(s) for i, s in enumerate(SEVERITIES.values())))
    real = found.groupBy(id_col).agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES.values()))
    differs = F.lit(False)
    for s in SEVERITIES.values():
        differs = differs | (F.col(s) != F.coalesce(f"n_{s}", F.lit(0)))
    counts = said.join(real, id_col, "left").select(id_col, F.when(F.col("CRITICAL").isNull(), "no severity counts").when(differs, "severity counts differ from the findings").alias("problem")).where("problem is not null")
    out = blocks
    for d in (twice, heads, near, counts):
        out = out.unionByName(d)
    return out


def register_gate(findings: DataFrame, by: str) -> DataFrame:
    """Refused while a CRITICAL or HIGH finding is open; open MEDIUM and LOW ones are listed."""
    open_ = F.col("status") == "open"
    return findings.groupBy(by).agg(
        F.count_if(open_ & F.col("severity").isin("CRITICAL", "HIGH")).alias("n_blocking"),
        F.array_sort(F.collect_list(F.when(open_ & F.col("severity").isin("MEDIUM", "LOW"), F.col("finding")))).alias("undisposed"),
    ).withColumn("passed", F.col("n_blocking") == 0)


def roadmap_items(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id, item, title, status, kind, epic, lane and line of each milestone or spike of a roadmap.

    An item's status is the best of its own line and of the first line in its
    section that declares one; an item given again keeps its first title and the
    best status.
    """
    lines = lines_of(df, id_col, text_col)
    c = F.col("text")
    own = F.regexp_extract(c, r"(?i)^\s*(?:#{2,5}\s+|[-*]\s+|\*\*)(?:\[.\]\s*)?\**(?:✅|🚧)?\s*(?:milestone\s+)?(m\d+[a-z]?|sp\d+)\b", 1)
    subject = c.rlike(r"^\s*(?:#{2,5}\s|[-*]\s|\*\*)")
    item = F.when(own != "", F.upper(own)).when(subject, X.backtick_id(c))
    epic = F.regexp_extract(c, r"^###\s+(E\d+|E-[A-Z0-9]+)\b", 1)
    lane = F.lower(F.regexp_extract(c, r"(?i)^#{2,5}\s+(Now|Next|Later)\b", 1))
    so_far = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda x: F.last(F.when(x != "", x), ignorenulls=True).over(so_far)
    marked = lines.withColumn("item", item).withColumn("epic", last(epic)).withColumn("lane", last(lane)).withColumn("section", F.sum(F.col("item").isNotNull().cast("int")).over(so_far))
    bare = F.regexp_replace(c, r"^[\s>*#-]+", "")
    declared = F.when(bare.rlike(r"^\[[ xX/~\-]\]|^(✅|☑|🚧|◐|🔍|☐)|^(DONE|SHIPPED|COMPLETE|LIVE)\b|^(?i:WIP|IN[\s-]?PROGRESS)\b"), X.status_of_line(bare))
    ranks = marked.where("section > 0").groupBy(id_col, "section").agg(
        F.min_by(F.struct("item", "text", "epic", "lane", "line"), "line").alias("h"), F.min_by(X.status_rank(declared), F.when(declared.isNotNull(), F.col("line"))).alias("declared")
    )
    best = F.greatest(X.status_rank(X.status_of_line(F.col("h.text"))), F.coalesce("declared", F.lit(0)))
    title = F.regexp_replace(F.regexp_replace("h.text", r"^[\s>*#-]*(\[.\])?[\s*]*", ""), r"(?i)^(?:milestone\s+)?[(\[]?(?:m\d+[a-z]?|sp\d+)[)\]]?\**\s*[:\-—]?\s*", "")
    each = ranks.select(id_col, F.col("h.item").alias("item"), X.semantic_title(F.regexp_replace(title, "[*`_]", "")).alias("title"), best.alias("rank"), F.col("h.epic").alias("epic"), F.col("h.lane").alias("lane"), F.col("h.line").alias("line"))
    merged = each.groupBy(id_col, "item").agg(F.min_by("title", "line").alias("title"), F.max("rank").alias("rank"), F.min_by("epic", F.when(F.col("epic").isNotNull(), F.col("line"))).alias("epic"), F.min_by("lane", F.when(F.col("lane").isNotNull(), F.col("line"))).alias("lane"), F.min("line").alias("line"))
    names = F.array(*map(F.lit, ("pending", "active", "done")))
    return merged.select(id_col, "item", "title", F.get(names, F.col("rank")).alias("status"), F.when(F.col("item").startswith("SP"), "spike").otherwise("milestone").alias("kind"), "epic", "lane", "line")


# States that end a document's life.
TERMINAL = ("superseded", "closed", "complete", "completed", "consumed", "cancelled", "archived", "done")


def terminal_state(df: DataFrame, *, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """id, state and evidence: a terminal state in the path, the frontmatter or a banner of the first 40 lines of the body; null if they differ."""
    words = "|".join(TERMINAL)
    lines = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "\n")
    fence = F.array_position(F.slice(F.transform(lines, lambda x: F.trim(x)), 2, 100), "---")
    start = F.when((F.trim(F.get(lines, F.lit(0))) == "---") & (fence > 0), fence + 2).otherwise(1).cast("int")
    body = F.when(start > F.size(lines), F.array().cast("array<string>")).otherwise(F.slice(lines, start, F.lit(40)))
    front = F.when(start > 1, F.slice(lines, F.lit(2), F.greatest(start - 3, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    banner = lambda line: F.regexp_extract(F.regexp_replace(F.regexp_replace(F.trim(line), r"^[>#*\s_-]+", ""), r"^\[[^\]]+\]\s*", ""), rf"(?i)^\**(?:status\s*:\s*)?\**\s*({words})\b", 1)
    named = lambda kind, found: F.transform(F.filter(found, lambda s: s != ""), lambda s: F.struct(F.lower(s).alias("state"), F.concat(F.lit(kind), F.lower(s)).alias("evidence")))
    path_hits = F.transform(F.split(path_col, "/"), lambda p: F.regexp_extract(p, rf"(?i)(?:^|[._-])({words})(?:[._-]|$)", 1))
    front_hits = F.transform(front, lambda line: F.regexp_extract(line, rf"(?i)^\s*[\w-]+\s*:\s*[\"']?({words})[\"']?\s*$", 1))
    found = F.concat(named("path-marker:", path_hits), named("frontmatter:", front_hits), named("opening-banner:", F.transform(body, banner)))
    rows = df.select(id_col, found.alias("f"))
    states = F.array_sort(F.array_distinct(F.transform("f", lambda x: x["state"])))
    evidence = F.array_sort(F.array_distinct(F.transform("f", lambda x: x["evidence"])))
    return rows.select(id_col, F.when(F.size(states) == 1, F.get(states, F.lit(0))).alias("state"), evidence.alias("evidence"), (F.size(states) > 1).alias("conflicting"))


def node_violations(nodes: DataFrame, *, allowed: Sequence[str], least: int = 2, most: int = 18) -> DataFrame:
    """case_id and code of every breach of the node policy; nodes: case_id, name, labels, group_id, expected_group."""
    kinds = F.array(*map(F.lit, allowed))
    typed = F.size(F.array_intersect("labels", kinds))
    odd = F.size(F.array_except("labels", F.concat(kinds, F.array(F.lit("Entity")))))
    n = Window.partitionBy("case_id", F.lower(F.trim("name"))).orderBy("name", "group_id")
    each = violations(
        nodes.withColumn("__again", F.row_number().over(n) > 1), "case_id",
        duplicate_entity_name=F.col("__again"), incidental_entity=incidental_reason(F.col("name")).isNotNull(), entity_type=typed != 1, unexpected_entity_label=odd > 0, entity_group_mismatch=F.col("group_id") != F.col("expected_group"),
    )
    counts = nodes.groupBy("case_id").count().where(~F.col("count").between(least, most)).select("case_id", F.lit("entity-count").alias("code"))
    return each.unionByName(counts)


def edge_violations(edges: DataFrame, *, allowed: Sequence[str], least: int = 1, most: int = 16) -> DataFrame:
    """case_id and code of every breach of the fact policy; edges: case_id, name, fact, episodes, valid_at, group_id, expected_group."""
    generic = F.upper("name").isin("RELATED_TO", "RELATES_TO")
    each = violations(
        edges, "case_id",
        generic_edge_type=generic, unexpected_edge_type=~generic & ~F.col("name").isin(list(allowed)), empty_fact=F.coalesce(F.trim("fact"), F.lit("")) == "", missing_provenance=F.coalesce(F.size("episodes"), F.lit(0)) <= 0,
        missing_valid_at=F.col("valid_at").isNull(), fact_group_mismatch=F.col("group_id") != F.col("expected_group"),
    )
    counts = edges.groupBy("case_id").count().where(~F.col("count").between(least, most)).select("case_id", F.lit("fact-count").alias("code"))
    return each.unionByName(counts)


def extraction_audit(cases: DataFrame, nodes: DataFrame, edges: DataFrame, *, node_kinds: Sequence[str], edge_kinds: Sequence[str]) -> DataFrame:
    """Per case: numbers of nodes, facts and breaches of either policy, and whether it is accepted."""
    count = lambda d, name: d.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    out = cases.select("case_id")
    for d, name in ((nodes, "n_nodes"), (edges, "n_facts"), (node_violations(nodes, allowed=node_kinds), "n_node_violations"), (edge_violations(edges, allowed=edge_kinds), "n_fact_violations")):
        out = out.join(count(d, name), "case_id", "left")
    return out.fillna(0).withColumn("accepted", (F.col("n_node_violations") == 0) & (F.col("n_fact_violations") == 0) & (F.col("n_nodes") > 0))


def handoff_problems(df: DataFrame, *, id_col: str, name: str, meta: str, body: str) -> DataFrame:
    """id and code of every rule of the handoff contract that a document breaks; meta: its frontmatter as a map."""
    m = lambda k: F.col(meta)[k]
    grammar = r"^HANDOFF-(\d{4}-\d{2}-\d{2})-[a-z0-9][a-z0-9-]*-(continuation|session-review)\.md$"
    suffix = F.regexp_extract(name, grammar, 2)
    kind = m("handoff_kind")
    expected = F.when(suffix == "continuation", "continuation").when(suffix == "session-review", "review")
    text = F.col(body)
    blank = lambda k: F.coalesce(m(k), F.lit("")) == ""
    return violations(
        df, id_col,
        file_name=~F.col(name).rlike(grammar), no_frontmatter=F.col(meta).isNull(), no_type=F.col(meta).isNotNull() & blank("type"), no_project=F.col(meta).isNotNull() & blank("project"), no_date=F.col(meta).isNotNull() & blank("date"),
        other_type=m("type") != "handoff", unknown_kind=~kind.isin("continuation", "review"), kind_differs=kind != expected, date_differs=m("date") != F.regexp_extract(name, grammar, 1),
        no_resume_here=(kind == "continuation") & ~text.rlike(r"(?i)RESUME\s+HERE"), no_summary=(kind == "review") & ~text.rlike(r"(?m)^#{1,6}\s.*TL;DR"), no_scrutiny=(kind == "review") & ~text.rlike("(?i)SCRUTIN"),
        no_roadmap=(kind == "review") & blank("roadmap"), secret=text.rlike(r"(?i)(?:secret|token|password)\s*[:=]\s*[\"']?[A-Za-z0-9+/_-]{16,}"),
    )


def append_sequence(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New records with seq from the number of records in the log on, in order; one writer appends at a time."""
    start = log.agg(F.count(F.lit(1)).alias("__n"))
    return numbered_rows(new, order).crossJoin(F.broadcast(start)).withColumn("seq", F.col("n") + 1 + F.col("__n")).drop("__n", "n")  # one row


def vector_set_proof(stored: DataFrame, expected: DataFrame, key: str, *payload: str) -> DataFrame:
    """One row: stored and expected counts, rows that are missing, extra or differ in payload, and whether the sets are proven equal."""
    a = stored.select(key, F.struct(*payload).alias("__a"))
    b = expected.select(key, F.struct(*payload).alias("__b"))
    out = a.join(b, key, "full").agg(
        F.count("__a").alias("n_stored"), F.count("__b").alias("n_expected"), F.count_if(F.col("__a").isNull()).alias("n_missing"), F.count_if(F.col("__b").isNull()).alias("n_extra"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_changed"),
    )
    return out.withColumn("proven", (F.col("n_missing") + F.col("n_extra") + F.col("n_changed") == 0) & (F.col("n_stored") == F.col("n_expected")))


def alarms(status: DataFrame, by: str, **tests: Column) -> DataFrame:
    """by, failures and alarm: a narrower verdict than the composite, with what failed."""
    names = F.array_compact(F.array(*(F.when(t, F.lit(n.replace("_", "-"))) for n, t in tests.items())))
    return status.select(by, names.alias("failures")).withColumn("alarm", F.size("failures") > 0)


def checkpointed_ingest(units: DataFrame, checkpoint: DataFrame, key: str, embed, sink) -> DataFrame:
    """Embeds and stores the units that the checkpoint lacks; returns their rows for it.

    embed: DataFrame -> DataFrame with a vector each (a short batch is an error);
    sink: an idempotent writer by key.
    """
    todo = units.join(checkpoint.where("status = 'completed'").select(key), key, "left_anti")
    ready = embed(todo)
    sink(ready)
    left = todo.join(ready.where("vector is not null").select(key), key, "left_anti")
    return ready.select(key, F.lit("completed").alias("status")).unionByName(left.select(key, F.lit("failed").alias("status"))).dropDuplicates([key])
