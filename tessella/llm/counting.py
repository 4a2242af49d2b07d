"""Token counts from distinct pre-tokens, without ids."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import common, tokenizing

#: Pre-tokens that a task gathers before it passes them on.
GATHERED = 200_000
#: The most frequent pre-tokens, whose counts every task gets; a longer one stands for itself by a digest, so they take 40 MB at most.
FREQUENT, LONGEST = 200_000, 64
#: Steps of a doubling of the frequency, by which the most frequent ones are told.
STEPS = 8


def key_of(piece: str) -> bytes:
    """The pre-token itself, or a digest of 65 bytes of one that is longer than LONGEST bytes."""
    data = piece.encode()
    return data if len(data) <= LONGEST else bytes(LONGEST - 31) + hashlib.blake2b(data, digest_size=32).digest()


def piece_table(df: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """piece, freq (over all texts), key (see key_of) and n_tokens of every distinct pre-token; the library sees each piece once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = tokenizing.encoder(tokenizer).pieces, Counter()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "freq"])
            seen.clear()
            return made

        for whole in batches:
            for part in common.text_slices(whole, 0):
                for text in part.column(0).to_pylist():
                    if text:
                        seen.update(find(text)[0])
                if len(seen) >= GATHERED:
                    yield batch()
        if seen:
            yield batch()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = tokenizing.encoder(tokenizer).count
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            yield batch.append_column("key", pa.array(map(key_of, pieces), pa.binary())).append_column("n_tokens", pa.array(map(n, pieces), pa.int64()))

    pieces = common.spread(df.select(text_col)).mapInArrow(common.releasing(gather, tokenizing.forget), "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return pieces.mapInArrow(common.releasing(count, tokenizing.forget), "piece string, freq long, key binary, n_tokens long")


def frequent_floor(pieces: DataFrame, most: int) -> float:
    """The least step of the frequency's logarithm from which on there are at most so many pre-tokens: one grouped count, nothing is sorted."""
    step = F.floor(F.log2("freq") * STEPS)
    total, floor = 0, float("inf")
    for r in sorted(pieces.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # a row a step: 504 at most
        total += r["count"]
        if total > most:
            break
        floor = r.step
    return floor


def count_tokens(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Distinct pre-tokens are counted once into a table.  Each document's
    frequencies meet it in two ways: the most frequent pre-tokens, a bounded
    number of bounded keys, in the task that reads the text, all others in a
    shuffled join, whose keys then hold few rows each.  Null or empty text has 0 of both; repeated rows are counted
    each; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    pieces = common.written(piece_table(df, tokenizer, text_col=text_col), "pieces")
    floor = frequent_floor(pieces, frequent)
    top = pieces.where(F.floor(F.log2("freq") * STEPS) >= floor).select("key", "n_tokens")
    short = lambda k: k.decode() if len(k) <= LONGEST else bytes(k)
    known = spark.sparkContext.broadcast({short(r.key): r.n_tokens for r in top.toLocalIterator()})
    parts = common.schema_of(("row", T.LongType()), common.field(df, id_col), ("n_bytes", T.LongType()), ("key", T.BinaryType()), ("n", T.LongType()))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = tokenizing.encoder(tokenizer).pieces, known.value
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part in common.text_slices(whole, 1):
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).to_pylist()
                totals, tail = [], ([], [], [])
                for text in part.column(1).to_pylist():
                    found, total = find(text) if text else ([], 0)
                    for piece, n in Counter(found).items():
                        if (c := counts.get(piece)) is None:
                            key = key_of(piece)
                            if len(key) <= LONGEST or (c := counts.get(key)) is None:
                                for out, x in zip(tail, (row, key, n)):
                                    out.append(x)
                                continue
                        total += c * n
                    totals.append(total)
                    row += 1
                rows, none = range(row - len(totals), row), pa.nulls
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), part.column(0), pa.array(size, pa.int64()), none(len(totals), pa.binary()), pa.array(totals, pa.int64())], names=parts.names)
                if tail[0]:
                    k = len(tail[0])
                    yield pa.RecordBatch.from_arrays([pa.array(tail[0], pa.int64()), none(k, part.column(0).type), none(k, pa.int64()), pa.array(tail[1], pa.binary()), pa.array(tail[2], pa.int64())], names=parts.names)

    found = common.written(common.spread(df.select(id_col, text_col)).mapInArrow(common.releasing(frequencies, tokenizing.forget), parts), "frequencies")
    rest = found.where("key is not null").join(pieces.select("key", "n_tokens"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("rest"))
    total = F.col("n") + F.coalesce("rest", F.lit(0))
    return found.where("key is null").join(rest, "row", "left").select(id_col, "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
