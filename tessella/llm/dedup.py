"""Exact dedup by content-defined chunk recipes.

Texts are cut where their own bytes say so; each distinct chunk moves once, to
the place where its identifier is verified; documents are then compared by their
ordered lists of identifiers, which take 16 bytes a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessella.llm import common

#: Shortest and longest chunk in bytes, and the mask of a cut's hash: one place in 4096 cuts.
LEAST, MOST, MASK = 1024, 65536, np.uint64(4095)
#: Groups with at least one in so many of all rows are broadcast; there are so many at most.
HEAVY = 1000


def cuts(data: bytes) -> list[int]:
    """Ends of a text's chunks: where the hash of the 8 bytes before it says so, between LEAST and MOST apart.

    >>> cuts(b"short")
    [5]
    """
    n = len(data)
    if n <= LEAST:
        return [n]
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    words = np.ascontiguousarray(window).view("<u8").ravel()
    with np.errstate(over="ignore"):
        words = (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    places = (np.flatnonzero((words & MASK) == 0) + 8).tolist()
    out, last = [], 0
    for place in [*places, n]:
        while place - last > MOST:
            last += MOST
            out.append(last)
        if place - last >= LEAST and place < n:
            out.append(place)
            last = place
    if not out or out[-1] < n:
        out.append(n)
    return out


def identify(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(df: DataFrame, text_col: str, name: Callable[[bytes], bytes]) -> DataFrame:
    """chunk_id and chunk of every text; repeats within a task's slice are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.text_slices(whole, 0):
                seen: dict[bytes, bytes] = {}
                clash: list[tuple[bytes, bytes]] = []
                for value in part.column(0).cast(pa.binary()).to_pylist():
                    data, last = value or b"", 0
                    for end in cuts(data):
                        chunk = data[last:end]
                        if seen.setdefault(key := name(chunk), chunk) != chunk:
                            clash.append((key, chunk))
                        last = end
                pairs = [*seen.items(), *clash]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.binary()), pa.array([c for _, c in pairs], pa.binary())], names=["chunk_id", "chunk"])

    return common.spread(df.select(text_col)).mapInArrow(common.releasing(cut), "chunk_id binary, chunk binary")


def _recipes(df: DataFrame, id_col: str, text_col: str, name: Callable[[bytes], bytes]) -> DataFrame:
    """id, recipe (the chunks' identifiers in order) and text_sha256 of every row."""
    out = common.schema_of(common.field(df, id_col), ("recipe", T.BinaryType()), ("text_sha256", T.StringType()))

    def recipe(data: bytes) -> bytes:
        ends = cuts(data)
        return b"".join(name(data[a:b]) for a, b in zip([0, *ends], ends))

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.text_slices(whole, 1):
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([recipe(x) for x in texts], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], names=out.names)

    return common.spread(df.select(id_col, text_col)).mapInArrow(common.releasing(cook), out)


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, name: Callable[[bytes], bytes] = identify) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when identical after `normalise` (none: no change); null
    counts as empty.  Of equal texts the row with the largest id stays; of rows
    equal in id too, one.  A null id stays only where no row of the group has
    one.  An empty table gives no rows; other columns are ignored.

    Should two different chunks ever share an identifier (`name` is a
    parameter), whole texts take the place of recipes.
    """
    common.small_batches(df.sparkSession)
    text = common.text_or_empty(text_col)
    df = df.select(F.col(id_col), (normalise(text) if normalise else text).alias("__text"))
    chunks = _chunks(df, "__text", name).distinct().groupBy("chunk_id").count()
    if chunks.where("count > 1").isEmpty():
        rows = _recipes(df, id_col, "__text", name)
    else:
        rows = df.select(id_col, F.col("__text").cast("binary").alias("recipe"), F.sha2("__text", 256).alias("text_sha256"))
    rows = common.written(rows, "recipes")
    groups = common.written(rows.groupBy("recipe").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    # Equal rows stand together, so that one of them can stay.
    rows = rows.groupBy(id_col, "recipe", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    floor = max(2, -(-_count(groups) // HEAVY))
    # A thousand rows at most, of a digest, an id and a number each, however long the texts are.
    digest = F.unhex(F.sha2("recipe", 256)).alias("digest")
    heavy = groups.where(F.col("group_size") >= floor).select(digest, F.col("keep_id").alias("heavy_id"), F.col("group_size").alias("heavy_size"))
    light = groups.where(F.col("group_size") < floor)
    marked = rows.withColumn("digest", digest).join(F.broadcast(heavy), "digest", "left")
    found = marked.where("heavy_size is not null").select(id_col, F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"), "text_sha256", "times")
    other = marked.where("heavy_size is null").join(light, "recipe").select(id_col, "keep_id", "group_size", "text_sha256", "times")
    each = found.unionByName(other).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "text_sha256")


def _count(groups: DataFrame) -> int:
    """All rows, from the groups' sizes."""
    return groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
