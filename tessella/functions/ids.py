"""Content-addressed identifiers as column expressions."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column, functions as F

#: This engine's own namespaces; changing one gives all rows new ids.
ARTIFACT_NAMESPACE = "tessella-artifact-1"
UNIT_NAMESPACE = UUID("6f0c7c3e-2a57-5d0e-9a53-5b8f5a0e6c11")
SEPARATOR = "\\0"


def artifact_id(path: Column) -> Column:
    return F.concat(F.lit("artifact:"), F.sha2(F.concat(F.lit(ARTIFACT_NAMESPACE + SEPARATOR), path), 256))


def revision_id(artifact: Column, content_sha256: Column) -> Column:
    return F.concat(F.lit("revision:"), F.sha2(F.concat(artifact, F.lit(SEPARATOR), content_sha256), 256))


def uuid5(namespace: UUID, name: Column) -> Column:
    """RFC 4122 version 5, from sha1 of the namespace's bytes and the name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def unit_id(revision: Column, chunk_index: Column, chunk_sha256: Column) -> Column:
    return uuid5(UNIT_NAMESPACE, F.concat_ws("\x00", revision, chunk_index.cast("string"), chunk_sha256))


def group_namespace(scope: Column, prefix: str) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(scope, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""))
    slug = F.when(slug == "", F.lit("workspace")).otherwise(slug)
    return F.concat(F.lit(prefix + "_"), F.substring(slug, 1, 48), F.lit("_"), F.substring(F.sha2(scope, 256), 1, 10))


def span_id(revision: Column, profile: str, byte_start: Column, byte_end: Column, span_sha256: Column) -> Column:
    return F.concat(F.lit("span:"), F.sha2(F.concat_ws("\x00", revision, F.lit(profile), byte_start.cast("string"), byte_end.cast("string"), span_sha256), 256))


def set_digest(leaf: Column) -> Column:
    """Order-free digest of a set: sha256 of the sorted leaf digests; an aggregate.

    Leaves meet in one place per group, so group by a bucket first where a group is large (see bucketed_digest).
    """
    return F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), ""), 256)


def bucketed_digest(df, leaf: Column, digits: int = 4):
    """One digest of any number of rows in two steps: leaves by their first hex digits, then the buckets' digests in order."""
    buckets = df.select(leaf.alias("leaf")).groupBy(F.substring("leaf", 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), set_digest(F.col("leaf")).alias("digest"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), ""), 256).alias("digest"))


def event_id(producer: Column, run: Column, artifacts_json: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", producer, run, artifacts_json), 256)


def alert_fingerprint(codes: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(codes), "\x00"), 256)
