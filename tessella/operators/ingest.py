"""Catalog, checkpoint and retention algebra over revisions, observations, units and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.segments import Segments
from tessella.operators.substrings import contains_pairs


def newest_complete_run(runs: DataFrame) -> DataFrame:
    """One row: the largest run_id that finished and is complete; null if none is."""
    return runs.where(F.col("finished_at").isNotNull() & (F.col("status") == "complete")).agg(F.max("run_id").alias("run_id"))


def current_revisions(revisions: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """Revisions seen by the newest complete run."""
    newest = newest_complete_run(runs).where("run_id is not null")
    seen = observations.join(F.broadcast(newest), "run_id", "left_semi")  # one row
    return revisions.join(seen.select("revision_id").distinct(), "revision_id", "left_semi")


def duplicate_content(df: DataFrame, *, digest: Column, item: str, size: Column) -> DataFrame:
    """digest, n_items and total_bytes of contents that several items share."""
    return df.select(digest.alias("digest"), F.col(item).alias("item"), size.alias("bytes")).groupBy("digest").agg(F.count_distinct("item").alias("n_items"), F.sum("bytes").alias("total_bytes")).where("n_items > 1")


def upsert_history(observed: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """A row a key: when it was first and last seen, and each column's latest value."""
    return observed.groupBy(key).agg(F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), *(F.max_by(c, order).alias(c) for c in columns))


def pending(units: DataFrame, done: DataFrame, key: str, *, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Units not done; a limit is a prefix of all units, not of those pending."""
    if limit is not None:
        # The n-th key by order bounds the prefix, so that no task numbers all rows.
        last = units.select(order or key).orderBy(order or key).limit(limit).agg(F.max(order or key).alias("__last"))
        units = units.join(F.broadcast(last), F.col(order or key) <= F.col("__last"), "left_semi")
    return units.join(done.select(key).distinct(), key, "left_anti")


def minus(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """base's keys that are in none of the others."""
    out = base.select(key).distinct()
    for other in others:
        out = out.join(other.select(key), key, "left_anti")
    return out


def as_of(points: DataFrame, versions: DataFrame, key: str, at: str, created: str) -> DataFrame:
    """points with the columns of the newest version not after them, and `ambiguous`: two versions share that time.

    Points and versions are one table, sorted once by key and time, along which the
    last version is carried on; no point meets more than one, and hot keys are cut
    into segments.  Of versions of one time the largest by its columns counts.
    Points without a version are left out, as are null keys and times.
    """
    names = points.columns
    extra = [c for c in versions.columns if c not in (key, created)]
    v = versions.where(F.col(key).isNotNull() & F.col(created).isNotNull())
    v = v.groupBy(key, created).agg(F.max(F.struct(created, *extra)).alias("__v"), F.count(F.lit(1)).alias("__n"))
    # Where times are equal, versions stand before points.
    olds = v.select(key, F.col(created).alias("__at"), F.lit(0).alias("__kind"), F.struct("__v", "__n").alias("__version"))
    news = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*names).alias("__point"))
    sizes = versions.select(key).unionByName(points.select(key))
    cut = Segments(olds.unionByName(news, allowMissingColumns=True), key, "__at", "__kind", sizes=sizes)
    held = cut.last_known(cut.rows, F.col("__version"), "__held").where("__kind = 1 and __held is not null")
    return held.select("__point.*", "__held.__v.*", (F.col("__held.__n") > 1).alias("ambiguous"))


def set_parity(left: DataFrame, right: DataFrame, key: str, samples: int = 20) -> DataFrame:
    """One row: counts of keys in both, only left, only right, and the first few of either kind."""
    l, r = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((left, "l"), (right, "r")))
    both = l.join(r, key, "full")
    counts = both.agg(F.count_if(F.col("l") & F.col("r")).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_only_left"), F.count_if(F.col("l").isNull()).alias("n_only_right"))
    some = lambda side, name: both.where(F.col(side).isNull()).orderBy(key).limit(samples).agg(F.array_sort(F.collect_list(key)).alias(name))
    return counts.crossJoin(some("r", "sample_only_left")).crossJoin(some("l", "sample_only_right"))  # one row each


def covered(needs: DataFrame, have: DataFrame, group: str, member: str) -> DataFrame:
    """Relational division: each group and whether all its members are among those had."""
    marked = needs.select(group, member).distinct().join(have.select(member).distinct().withColumn("__in", F.lit(True)), member, "left")
    return marked.groupBy(group).agg(F.count(F.lit(1)).alias("n_needed"), F.count("__in").alias("n_had")).withColumn("covered", F.col("n_needed") == F.col("n_had"))


def lifecycle_plan(points: DataFrame, current: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose flag differs from membership in current, with the value to set; nothing is deleted."""
    member = current.select(key).distinct().withColumn("__in", F.lit(True))
    out = points.join(member, key, "left").withColumn("set_to", F.coalesce("__in", F.lit(False))).drop("__in")
    return out.where(~F.col(flag).eqNullSafe(F.col("set_to")))


def dead_letters(failures: DataFrame, key: str, at: str, reason: str) -> DataFrame:
    """A row a key: occurrences, first and last time, and the last reason."""
    return failures.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(reason, F.struct(at, reason)).alias("last_reason"))


# States of a dead letter, and where each action takes it.
LETTER_MOVES = (("open", "resolve", "resolved"), ("open", "replay", "replaying"), ("replaying", "succeed", "resolved"), ("replaying", "fail", "open"), ("resolved", "fail", "open"))


def letter_transitions(letters: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """letters after one action each; an action that a state does not know leaves it and is refused."""
    moves = letters.sparkSession.createDataFrame(LETTER_MOVES, "status string, action string, moved string")
    out = letters.join(actions.select(key, "action"), key, "left").join(F.broadcast(moves), ["status", "action"], "left")  # five rows
    refused = F.col("action").isNotNull() & F.col("moved").isNull()
    return out.withColumn("refused", refused).withColumn("status", F.coalesce("moved", "status")).drop("moved")


def supersede(jobs: DataFrame, target: str, run: str, status: str) -> DataFrame:
    """jobs with older unfinished runs of a target superseded by its newest."""
    newest = jobs.groupBy(target).agg(F.max(run).alias("__newest"))
    older = (F.col(run) < F.col("__newest")) & F.col(status).isin("pending", "failed")
    return jobs.join(newest, target).withColumn(status, F.when(older, "superseded").otherwise(F.col(status))).drop("__newest")


def due_job(jobs: DataFrame, now: Column) -> DataFrame:
    """The one due job with the highest run: pending or failed, its time come."""
    return jobs.where(F.col("status").isin("pending", "failed") & (F.col("due_at") <= now)).orderBy(F.desc("run_id"), "target").limit(1)


def transitions(states: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Rows whose state differs from the key's previous one, with it; the first row counts as a change."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(at))
    return states.withColumn("previous", before).where(~F.col(state).eqNullSafe(F.col("previous")))


def last_action(log: DataFrame, key: str, order: str, action: str) -> DataFrame:
    return log.groupBy(key).agg(F.max_by(action, order).alias(action))


def newest_n(rows: DataFrame, group: str, *order: Column, keep: int, protected: Column | None = None) -> DataFrame:
    """rows with `rotate`: beyond the newest n of their group; protected rows neither count nor go."""
    guard = protected if protected is not None else F.lit(False)
    n = F.row_number().over(Window.partitionBy(group, guard).orderBy(*order))
    return rows.withColumn("rotate", ~guard & (n > keep))


def stale_receipts(receipts: DataFrame, catalog: DataFrame, key: str, *columns: str) -> DataFrame:
    """receipts with `state`: missing from the catalog, stale if any column differs, else current."""
    named = catalog.select(key, F.struct(*columns).alias("__now"))
    out = receipts.join(named, key, "left")
    return out.withColumn("state", F.when(F.col("__now").isNull(), "missing").when(F.struct(*columns).eqNullSafe(F.col("__now")), "current").otherwise("stale")).drop("__now")


def archive_backfill(archived: DataFrame, source: DataFrame, complete: DataFrame, key: str, group: str, digest: str, content: str) -> DataFrame:
    """The archive after a run: new and corrupt rows come from sources that are complete; a group without all its rows adds none."""
    intact = archived.where(F.sha2(content, 256) == F.col(digest))
    fresh = source.join(complete.select(group), group, "left_semi").where(F.sha2(content, 256) == F.col(digest))
    whole = covered(source, fresh, group, key).where("covered").select(group)
    added = fresh.join(whole, group, "left_semi").join(intact.select(key), key, "left_anti")
    return intact.unionByName(added.select(*intact.columns))


def resolve_owner(items: DataFrame, owners: DataFrame, *, item: str, text: str) -> DataFrame:
    """item and owner: of the owners with a signal in the text, the one with the earliest, then longest signal, then first in order.

    owners: owner, signal, place; any number of them.
    """
    signals = owners.select(F.struct("owner", "place").alias("needle_id"), F.col("signal").alias("needle"))
    hits = contains_pairs(items.select(item, F.lower(text).alias("__t")), signals, doc=item, text="__t")
    order = F.struct("at", (-F.length("needle")).alias("l"), "needle_id.place")
    return hits.groupBy(item).agg(F.min_by("needle_id.owner", order).alias("owner"))


def backlinks(documents: DataFrame, needles: DataFrame, *, doc: str, text: str) -> DataFrame:
    """needle_id and doc of every document that has the needle; null needles match nothing."""
    return contains_pairs(documents, needles, doc=doc, text=text).select("needle_id", doc)


def alias_references(documents: DataFrame, aliases: DataFrame, *, doc: str, text: str) -> DataFrame:
    """alias and doc of every text that names an alias path, with slashes, dots and case as they may vary; each blocks the alias's removal."""
    flat = F.regexp_replace(F.lower(F.translate(text, "\\", "/")), r"(^|[\s(\[\"'`])\./", "$1")
    short = aliases.select(F.col("alias").alias("needle_id"), F.regexp_replace(F.lower("alias"), r"^\./|/+$", "").alias("needle"))
    hit = contains_pairs(documents.select(doc, flat.alias("__t")), short, doc=doc, text="__t")
    return hit.select(F.col("needle_id").alias("alias"), doc)


def append_history(rows: DataFrame, changes: DataFrame, key: str, state: str = "status") -> DataFrame:
    """rows with the changes' states, each appended to the history; a change to the same state is none.  history: array of struct<state, at>."""
    new = changes.select(key, F.col(state).alias("__new"), F.col("at").alias("__at"))
    out = rows.join(new, key, "left")
    moved = F.col("__new").isNotNull() & (F.col("__new") != F.col(state))
    entry = F.struct(F.col("__new").alias("state"), F.col("__at").alias("at"))
    history = F.when(moved, F.array_append("history", entry)).otherwise(F.col("history"))
    return out.withColumn("history", history).withColumn(state, F.when(moved, F.col("__new")).otherwise(F.col(state))).drop("__new", "__at")


def point_rows(ranked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Ranked points with their rows; points without one are dropped and leave a gap, as ranks come from before the join."""
    return ranked.join(rows, key)


def still_current(results: DataFrame, current: DataFrame, key: str = "revision_id") -> DataFrame:
    return results.join(current.select(key).distinct(), key, "left_semi")


def coalesce_rows(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """Overlay: the new side's row where there is one."""
    o = old.select(key, F.struct(*columns).alias("__o"))
    n = new.select(key, F.struct(*columns).alias("__n"))
    return o.join(n, key, "full").select(key, F.coalesce("__n", "__o").alias("v")).select(key, "v.*")


def merge_structure(old: DataFrame, new: DataFrame, key: str, structure: list[str], state: list[str], status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(merged rows: structure from new, state from old where known; dropped rows that are not pending, which a caller must refuse)."""
    kept = old.select(key, *(F.col(c).alias(f"__{c}") for c in state))
    merged = new.join(kept, key, "left").select(key, *structure, *(F.coalesce(f"__{c}", c).alias(c) for c in state))
    return merged, old.where(F.col(status) != "pending").join(new.select(key), key, "left_anti")


def reconcile(register: DataFrame, document: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Findings over three sources of status: ids that one lacks, and statuses that differ."""
    r, d, s = (t.select(key, F.col("status").alias(n)) for t, n in ((register, "r"), (document, "d"), (state, "s")))
    out = r.join(d, key, "full").join(s, key, "full")
    finding = F.when(F.col("r").isNull(), "not-in-register").when(F.col("d").isNull(), "not-in-document").when(F.col("s").isNull(), "not-in-state").when((F.col("r") != F.col("d")) | (F.col("r") != F.col("s")), "status-differs")
    return out.withColumn("finding", finding).where("finding is not null")


def plan_against_existing(planned: DataFrame, existing: DataFrame, key: str, target: str) -> DataFrame:
    """key and bucket: create, keep, retarget, adopt, remove, foreign, conflict or refused."""
    p = planned.select(key, F.col(target).alias("want"), F.col("action"))
    e = existing.select(key, F.col(target).alias("have"), F.col("owned"), F.col("is_link"))
    out = p.join(e, key, "full")
    bucket = (
        F.when(F.col("want").isNull(), F.when(F.col("owned"), "remove").otherwise("foreign"))
        .when(F.col("action") == "exclude", F.when(F.col("have").isNull(), "refused").otherwise("remove"))
        .when(F.col("have").isNull(), "create")
        .when(~F.col("is_link"), "conflict")
        .when(F.col("have") == F.col("want"), F.when(F.col("owned"), "keep").otherwise("adopt"))
        .otherwise(F.when(F.col("owned"), "retarget").otherwise("conflict"))
    )
    return out.select(key, bucket.alias("bucket"))


def resolve_links(links: DataFrame, files: DataFrame, *, target: str = "target", path: str = "path") -> DataFrame:
    """links with `resolved` and `state`: the exact path, else the only file of that name, else ambiguous or broken."""
    names = files.select(path, F.substring_index(path, "/", -1).alias("__name"))
    exact = files.select(F.col(path).alias(target), F.col(path).alias("__exact")).distinct()
    by_name = names.groupBy("__name").agg(F.count_distinct(path).alias("__n"), F.min(path).alias("__only"))
    out = links.join(exact, target, "left").withColumn("__name", F.substring_index(target, "/", -1)).join(by_name, "__name", "left")
    state = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__n") == 1, "by-name").when(F.col("__n") > 1, "ambiguous").otherwise("broken")
    return out.withColumn("state", state).withColumn("resolved", F.when(state == "exact", F.col("__exact")).when(state == "by-name", F.col("__only"))).drop("__exact", "__n", "__only", "__name")


def broken_references(texts: DataFrame, targets: DataFrame, *, pattern: str, item: str, text: str, name: str) -> DataFrame:
    """item and reference: those that a text makes and no target has."""
    refs = texts.select(item, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("reference"))
    return refs.join(targets.select(F.col(name).alias("reference")), "reference", "left_anti").select(item, "reference")
