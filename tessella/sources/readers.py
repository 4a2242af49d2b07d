"""Readers: policy scans, frontmatter, tiers of content, tolerant and strict logs, outboxes, receipts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessella.operators.classify import file_name, glob_match
from tessella.session import durable

#: Characters of a text in which hints are looked for.
HINT = 128 * 1024


#: Times that a file is read until it did not change meanwhile.
ATTEMPTS = 3


def _listed(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """root, path, relative_path, length, modificationTime and content of all files below the roots, as listed now."""
    frames = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("root", F.lit(root)) for root in roots]
    files = reduce(DataFrame.unionByName, frames)
    rel = F.regexp_replace(F.expr("substring(path, instr(path, trim(both '/' from regexp_replace(root, '^[a-z]+:/*', ''))) + length(trim(both '/' from regexp_replace(root, '^[a-z]+:/*', ''))))"), "^/+", "")
    return files.withColumn("relative_path", rel)


def stable_read(spark: SparkSession, roots: Sequence[str], wanted: Column) -> tuple[DataFrame, DataFrame]:
    """(root, path, relative_path, length, modificationTime, content_sha256, head of the wanted files; those that changed at every attempt).

    A file counts as read when a listing after the read has its size and time as
    before, and as many bytes were read.  Others are read again, ATTEMPTS times in
    all; files that have gone by then are among the changed.  The times of those
    left reach the scan, so that few other files are opened again.
    """
    done, left = None, None
    for _ in range(ATTEMPTS):
        now = _listed(spark, roots).where(wanted)
        if left is not None:
            since = left.agg(F.min("seen")).first()[0]
            if since is None:
                break
            now = now.where(F.col("modificationTime") >= F.lit(since)).join(left.select("root", "path"), ["root", "path"], "left_semi")
        read = durable(now.select("root", "path", "relative_path", "length", "modificationTime", F.sha2("content", 256).alias("content_sha256"), F.lower(F.substring(F.decode("content", "utf-8"), 1, HINT)).alias("head"), F.octet_length("content").alias("n_read")), "read")
        after = _listed(spark, roots).select("root", "path", F.col("length").alias("__length"), F.col("modificationTime").alias("seen"))
        read = durable(read.join(after, ["root", "path"], "left"), "checked")
        same = F.col("length").eqNullSafe(F.col("__length")) & F.col("modificationTime").eqNullSafe(F.col("seen")) & (F.col("n_read") == F.col("length"))
        good = read.where(same).drop("__length", "seen", "n_read")
        done = good if done is None else done.unionByName(good)
        missed = read.where(~same).select("root", "path", "relative_path", "length", "seen")
        if left is not None:
            # Files that were not there to be read this time stay among those left.
            missed = missed.unionByName(left.join(read, ["root", "path"], "left_anti"))
        left = missed
        if left.isEmpty():
            break
    return done, left


def scan_files(spark: SparkSession, roots: Sequence[str], *, includes: Sequence[str], excludes: Sequence[str] = (), prune: Sequence[str] = (), suffixes: Sequence[str] = (".md", ".txt", ".json", ".csv")) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, counts by outcome) of the files below the roots: default-deny globs, pruned directory names, known suffixes.

    Rows: root, relative_path, byte_size, mtime, content_sha256, head (lower-cased,
    the first 128 KiB).  Contents are read only of the files that pass, and until
    they do not change meanwhile (see stable_read); those that always do have the
    outcome changed and no row.  A path that two roots give is an error of its own
    (outcome duplicate).
    """
    pruned = F.exists(F.split("relative_path", "/"), lambda p: p.isin(list(prune))) if prune else F.lit(False)
    known = F.lit(False)
    for s in suffixes:
        known = known | F.lower(file_name(F.col("relative_path"))).endswith(s)
    outcome = F.when(pruned, "pruned").when(glob_match(F.col("relative_path"), excludes), "excluded").when(~known, "suffix").when(~glob_match(F.col("relative_path"), includes, fold=True), "not-included").otherwise("cataloged")
    kept, changed = stable_read(spark, roots, outcome == "cataloged")
    others = _listed(spark, roots).withColumn("outcome", outcome).where("outcome <> 'cataloged'").select("outcome", "length")
    named = others.unionByName(kept.select(F.lit("cataloged").alias("outcome"), "length")).unionByName(changed.select(F.lit("changed").alias("outcome"), "length"))
    stats = named.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    rows = kept.select("root", "relative_path", F.col("length").alias("byte_size"), F.col("modificationTime").alias("mtime"), "content_sha256", "head")
    twice = kept.groupBy("relative_path").count().where("count > 1")
    return rows, stats.unionByName(twice.agg(F.lit("duplicate").alias("outcome"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("bytes")).where("n > 0"))


def frontmatter(text: Column) -> Column:
    """A map of the leading --- block's `key: value` lines; null without one."""
    block = F.regexp_extract(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda line: line.rlike(r"^\s*[A-Za-z0-9_-]+\s*:"))
    entry = lambda line: F.struct(F.trim(F.regexp_extract(line, r"^\s*([A-Za-z0-9_-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*[A-Za-z0-9_-]+\s*:", ""), "^\\s*[\"']|[\"']\\s*$", "")).alias("value"))
    # The last of equal keys wins.
    distinct = F.aggregate(F.transform(pairs, entry), F.array().cast("array<struct<key:string,value:string>>"), lambda acc, e: F.array_append(F.filter(acc, lambda a: a["key"] != e["key"]), e))
    return F.when(block != "", F.map_from_entries(distinct))


def content_tier(spark: SparkSession, path: str, tier: str, *, pattern: str = "*.md") -> DataFrame:
    """tier, name, title, content of one directory of Markdown files; a missing directory has none.

    The name is that of the file, or of its directory for files called SKILL.md;
    the title is the frontmatter's name, else the first heading, else the name.
    """
    out = T.StructType([T.StructField(c, T.StringType()) for c in ("tier", "name", "title", "description", "content")])
    try:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    except Exception as e:  # a tier that was never set up is empty
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], out)
        raise
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    parts = F.split("file", "/")
    last, above = F.element_at(parts, -1), F.element_at(parts, -2)
    name = F.when(F.upper(last) == "SKILL.MD", above).otherwise(F.regexp_replace(last, r"\.[^.]*$", ""))
    meta = frontmatter(F.col("content"))
    heading = F.regexp_extract("content", r"(?m)^#\s+(.+?)\s*$", 1)
    named = rows.select(F.lit(tier).alias("tier"), name.alias("name"), meta.alias("m"), heading.alias("h"), "content")
    return named.select("tier", "name", F.coalesce(F.col("m")["name"], F.nullif("h", F.lit("")), "name").alias("title"), F.col("m")["description"].alias("description"), F.trim("content").alias("content"))


def knowledge(spark: SparkSession, tiers: dict[str, str]) -> DataFrame:
    """The tiers' rows together, in their order by name."""
    frames = [content_tier(spark, path, tier) for tier, path in tiers.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def overlay(base: DataFrame, over: DataFrame, key: str = "name") -> DataFrame:
    """base and over by key; over wins."""
    return base.join(over.select(key), key, "left_anti").unionByName(over.select(*base.columns))


def json_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with the counts of good and malformed lines) of a JSON-lines log; blank lines are neither."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select(*(F.col(f"r.{f.name}") for f in schema.fields)), parsed.agg(F.count_if(~bad).alias("n_rows"), F.count_if(bad).alias("n_malformed"))


def strict_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file that must have all of the schema's keys and no others; an unknown or missing key fails the read."""
    keys = F.json_object_keys("value")
    names = F.array(*(F.lit(f.name) for f in schema.fields))
    odd = (F.size(F.array_except(keys, names)) > 0) | (F.size(F.array_except(names, keys)) > 0) | keys.isNull()
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = lines.select(F.when(odd, F.raise_error(F.concat(F.lit("unexpected keys: "), F.substring("value", 1, 200)))).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def unknown_keys(map_or_json: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(F.json_object_keys(map_or_json), F.array(*map(F.lit, allowed)))


def string_array(json: Column) -> Column:
    """An array of strings from JSON; null if it is anything else."""
    return F.when(json.rlike(r'^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'), F.from_json(json, "array<string>"))


def json_bounds(json: Column) -> Column:
    """(depth, nodes) of a JSON text: brackets outside strings, and separators."""
    bare = F.regexp_replace(json, r'"([^"\\]|\\.)*"', '""')
    step = lambda acc, c: F.struct(
        (acc["d"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("d"),
        F.greatest(acc["m"], acc["d"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("m"),
        (acc["n"] + c.isin("[", "{", ",").cast("int")).alias("n"),
    )
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"), F.lit(1).alias("n"))
    return F.aggregate(F.split(F.regexp_replace(bare, r"[^\[\]{},]", ""), ""), zero, step, lambda a: F.struct(a["m"].alias("depth"), a["n"].alias("nodes")))
