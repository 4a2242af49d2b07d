"""Declared schemas of the engine's tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()),
}


def struct(text: str, *more: T.StructField) -> T.StructType:
    """A struct from "name type, ..." without a session, so that workers can import it."""
    named = (f.split(" ", 1) for f in text.split(", "))
    return T.StructType([*(T.StructField(n, _TYPES[t]) for n, t in named), *more])


REVISIONS = struct(
    "revision_id string, artifact_id string, content_sha256 string, relative_path string, byte_size long, mtime_ns long, "
    "artifact_type string, authority_class string, lifecycle_hints array<string>, source_scope string, repository string, "
    "project string, observed_run_id long, observed_at timestamp"
)
SCAN_RUNS = struct(
    "run_id long, started_at timestamp, finished_at timestamp, status string, artifact_count long, byte_count long, "
    "missing_required_roots long, unreadable_files long, changed_during_scan long, error string"
)
OBSERVATIONS = struct("run_id long, revision_id string")
UNITS = struct(
    "unit_id string, point_id string, artifact_id string, revision_id string, chunk_index int, chunk_sha256 string, heading string, "
    "overlap_prefix_chars int, content string, embedding_text string, group_id string, reference_time timestamp"
)
SPANS = struct(
    "point_id string, span_id string, artifact_id string, revision_id string, char_start long, char_end long, byte_start long, "
    "byte_end long, line_start long, line_end long, heading string, identifiers array<string>, content string, "
    "embedding_text string, content_tokens int, embedding_tokens int, ready boolean, catalog_current boolean"
)
SINK_UNITS = struct("sink string, target string, unit_id string, revision_id string, status string, attempt_count int, external_id string, detail string, updated_at timestamp")
RECEIPT_ARTIFACT = struct("path string, revision_id string, content_sha256 string, byte_size long")
RECEIPTS = struct("event_id string, producer string, run_id string, observed_at timestamp", T.StructField("artifacts", T.ArrayType(RECEIPT_ARTIFACT)))
EVENT_STATE = struct("event_id string, digest string, status string, attempts long, first_seen timestamp, last_seen timestamp, detail string")
DEAD_LETTERS = struct("event_id string, reason string, occurrences long, first_seen timestamp, last_seen timestamp, status string")
TOKEN_LOG = struct(
    "ts timestamp, sessionId string, tool string, inputEst long, outputEst long, ms double, args string, outputHash string, section string, "
    "forced boolean, chunked boolean, sessionTok long, isError boolean, large boolean, cached boolean, outputSavedEst long, error string"
)
JUDGMENTS = struct("query_id string, span_id string, grade int, relative_path string, revision_id string, point_id string, byte_start long, byte_end long, span_sha256 string")
FACTS = struct("src string, rel string, dst string, fact string, group_id string, valid_at timestamp, invalid_at timestamp, episodes array<string>")
CHECKS = struct("name string, observed double, op string, threshold double")
