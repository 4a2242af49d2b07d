"""Which texts contain which strings, by an index of the strings' rarest q-grams: one plan at every size.

Each string is known by one anchor, the q-gram of its bytes that is rarest in a
sample of the texts (shorter strings are their own anchor).  Texts are read once,
in Arrow batches, and emit only those of their q-grams that a Bloom filter of the
anchors knows; these are equi-joined with the strings, and each pair is verified
on the text itself.  No text meets a string with which it does not share an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessella.operators.search import few
from tessella.session import durable, small_batches, spread, text_slices

#: Bytes of an anchor; bits of the Bloom filter and of the sample's counters; texts of the sample, and bytes of each that are counted.
GRAM, BLOOM_BITS, COUNTER_BITS, SAMPLED, HEAD = 8, 26, 20, 2000, 1 << 16
#: Bytes of a text whose q-grams are looked up at a time.
PIECE = 1 << 21
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The q-grams of some bytes, as numbers that also tell their size."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    out = (out + np.uint64(size)) * _ODD[0]
    return (out ^ (out >> np.uint64(29))) * _ODD[1]


def _sampled_counts(texts: DataFrame, text: str) -> np.ndarray:
    """How often q-grams occur in a bounded sample of the texts, in a table of fixed size; it only chooses anchors, so the result does not depend on it."""
    n = texts.count()
    drawn = texts if n <= SAMPLED else texts.where(F.pmod(F.xxhash64(text), F.lit(n)) < SAMPLED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for part in text_slices(batch, 0):
                # Texts stand one after the other: the few q-grams across their ends do no harm.
                data = np.frombuffer(b"".join(t[:HEAD] for t in part.column(0).cast(pa.binary()).to_pylist() if t), np.uint8)
                total += np.bincount((grams(data, GRAM) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.astype(np.uint32).tobytes()], pa.binary())})

    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in drawn.select(text).repartition(4).mapInArrow(count, "counts binary").toLocalIterator():
        total += np.frombuffer(r.counts, np.uint32)
    return total


def _anchored(needles: DataFrame, counts: np.ndarray) -> DataFrame:
    """needles with their anchor and its size."""
    shared = needles.sparkSession.sparkContext.broadcast(counts)
    out = T.StructType([*needles.schema.fields, T.StructField("anchor", T.LongType()), T.StructField("size", T.IntegerType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for t in batch.column(batch.schema.get_field_index("needle")).cast(pa.binary()).to_pylist():
                sizes.append(min(GRAM, len(t)))
                g = grams(np.frombuffer(t, np.uint8), sizes[-1])
                found.append(g[shared.value[(g >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].argmin()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())], names=out.names)

    return needles.mapInArrow(choose, out)


def _bloom(anchors: DataFrame) -> np.ndarray:
    """Bits of the anchors: a table of fixed size, 8 MB, put together by words of 64 bits."""
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    place = F.shiftrightunsigned("anchor", 64 - BLOOM_BITS)
    words = anchors.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(anchor, %d) & 63 as int))" % (64 - BLOOM_BITS)).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    for batch in words.toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return bits


def _hits(texts: DataFrame, doc: str, text: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc and anchor: the distinct q-grams of each text that the filter knows."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    out = T.StructType([T.StructField("doc", texts.schema[doc].dataType), T.StructField("anchor", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for part in text_slices(whole, 1):
                rows, found = [], []
                for i, t in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    own = []
                    for at in range(0, len(t or b""), PIECE):
                        data = np.frombuffer(t, np.uint8, min(PIECE + GRAM - 1, len(t) - at), at)
                        for size in sizes:
                            g = grams(data, size)
                            place = g >> np.uint64(64 - BLOOM_BITS)
                            own.append(np.unique(g[(known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0]))
                    if own:
                        g = np.unique(np.concatenate(own))
                        found.append(g)
                        rows.append(np.full(len(g), i))
                if found:
                    rows_ = pa.array(np.concatenate(rows).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows_), pa.array(np.concatenate(found).view(np.int64))], names=out.names)

    return spread(texts.select(doc, text)).mapInArrow(find, out)


def contains_pairs(texts: DataFrame, needles: DataFrame, *, doc: str, text: str) -> DataFrame:
    """doc, needle_id, needle and at (place of the first occurrence, in characters from 1) of every text that contains a needle.

    needles: needle_id and needle.  Nulls on either side match nothing; an empty
    needle is in every text.  Pairs are distinct; texts that share an id are looked
    at one by one, and of places the first is given.
    """
    spark: SparkSession = texts.sparkSession
    small_batches(spark)
    rows = texts.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text is not null")
    listed = needles.select("needle_id", "needle").where("needle is not null").distinct()
    anchored = durable(_anchored(listed.where("needle <> ''"), _sampled_counts(rows, "text")), "anchors")
    sizes = sorted(r.size for r in anchored.select("size").distinct().collect())  # GRAM at most
    n = anchored.count()
    hits = _hits(rows, "doc", "text", _bloom(anchored), sizes)
    pairs = hits.join(few(anchored.select("needle_id", "needle", "anchor"), n), "anchor").select(F.struct("doc").alias("key"), "needle_id", "needle")
    pairs = durable(pairs, "pairs")
    # Candidates meet their texts: broadcast if counted to be few, so that texts are not shuffled.
    found = rows.withColumn("key", F.struct("doc")).join(few(pairs), "key").withColumn("at", F.position("needle", "text")).where("at > 0").select("doc", "needle_id", "needle", "at")
    empty = listed.where("needle = ''")
    if not empty.isEmpty():
        found = found.unionByName(rows.select("doc").crossJoin(few(empty)).withColumn("at", F.lit(1)))  # every text is in the result
    return found.groupBy("doc", "needle_id", "needle").agg(F.min("at").alias("at")).withColumnRenamed("doc", doc)
