"""Token files of bit or byte planes, compressed plane by plane, with a chunk index.

File: MAGIC; the planes of each block one after another; a zstandard frame with
the JSON index; the frame's length (8 bytes, little-endian); MAGIC again.  A
block of `block` ids is transposed: plane p holds bit p (or byte p) of every id,
and is a zstandard frame of its own.  The index has the number of ids and the
planes' lengths of every block and the id and token count of every document.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessella.llm import common, tokenizing

MAGIC = b"TSLPLANE"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids; planes of zeros at the top are left out."""
    by_byte = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = (int(ids.max()).bit_length() if len(ids) else 0) if mode == "bit" else 32
    if mode == "byte":
        return [by_byte[:, p].tobytes() for p in range(4) if p == 0 or by_byte[:, p].any()]
    return [np.packbits((ids >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little").tobytes() for p in range(used)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for p, plane in enumerate(planes):
        data = np.frombuffer(plane, np.uint8)
        if mode == "byte":
            ids |= data.astype(np.uint32) << np.uint32(8 * p)
        else:
            ids |= np.unpackbits(data, count=n, bitorder="little").astype(np.uint32) << np.uint32(p)
    return ids


class Writer:
    """Appends documents' ids to one file; holds a block at most in memory."""

    def __init__(self, stream: Any, block: int, mode: str, level: int):
        self.stream, self.block, self.mode = stream, block, mode
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        self.blocks: list[list[int]] = []
        self.docs: list[Any] = []
        self.counts: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: Any, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            self._emit(False)

    def _emit(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        most = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, most, self.block):
            part = ids[at : min(at + self.block, most)]
            frames = [self.zip.compress(p) for p in to_planes(part, self.mode)]
            self.blocks.append([len(part), *map(len, frames)])
            for frame in frames:
                self.stream.write(frame)
        self.waiting, self.n_waiting = [ids[most:].tobytes()], len(ids) - most

    def close(self) -> None:
        self._emit(True)
        index = self.zip.compress(json.dumps({"mode": self.mode, "blocks": self.blocks, "docs": self.docs, "counts": self.counts}).encode())
        self.stream.write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Random access to one file's documents through its chunk index."""

    def __init__(self, stream: Any, size: int):
        self.stream, self.unzip = stream, zstandard.ZstdDecompressor()
        stream.seek(size - 8 - len(MAGIC))
        tail = stream.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a complete token file")
        length = int.from_bytes(tail[:8], "little")
        stream.seek(size - 8 - len(MAGIC) - length)
        index = json.loads(self.unzip.decompress(stream.read(length)))
        self.mode, self.blocks, self.docs, self.counts = index["mode"], index["blocks"], index["docs"], index["counts"]
        self.at = np.cumsum([len(MAGIC), *(sum(b[1:]) for b in self.blocks)]).tolist()
        self.first = np.cumsum([0, *(b[0] for b in self.blocks)])
        self.starts = np.cumsum([0, *self.counts], dtype=np.int64)
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self.held[0] != i:
            self.stream.seek(self.at[i])
            data, planes, at = self.stream.read(sum(self.blocks[i][1:])), [], 0
            for length in self.blocks[i][1:]:
                planes.append(self.unzip.decompress(data[at : at + length]))
                at += length
            self.held = (i, from_planes(planes, self.blocks[i][0], self.mode))
        return self.held[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end-1 of the file."""
        out = []
        i = int(np.searchsorted(self.first, start, "right")) - 1
        while start < end:
            a = int(self.first[i])
            part = self.block(i)[start - a : end - a]
            out.append(part)
            start += len(part)
            i += 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_token_files(
    df: DataFrame, tokenizer: str, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, block: int = 1 << 16, mode: str = "byte", level: int = 1
) -> DataFrame:
    """Writes the rows' ids in ascending id order; returns the manifest: file, part, n_docs, n_ids.

    Rows are dealt by ranges of (id, hash of text), so a repeated id is no hot
    spot; each range is one file, whose name sorts as its ids do.  Null ids come
    first, then ties by text; null text counts as empty, which leaves end_id;
    an empty table gives no files.  A file appears under its name only when
    complete; a task that runs again, or twice at once, writes the same bytes, and
    the first file stays.  Ids stand in the index as texts, so they can be of any
    type that Spark casts to a string and back; binary ones are an error.
    """
    if isinstance(df.schema[id_col].dataType, T.BinaryType):
        raise ValueError("ids of token files cannot be binary")
    spark = df.sparkSession
    common.small_batches(spark)
    path = path or common.shared_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer, stream = TaskContext.get(), None, None
        encode, end = tokenizing.encoder(tokenizer).encode, np.asarray([end_id], "<u4").tobytes()
        name = f"part-{context.partitionId():06d}.planes"
        store, base = fs.FileSystem.from_uri(path)
        draft = posixpath.join(base, f".{name}.{context.taskAttemptId()}")
        for whole in batches:
            for part in common.text_slices(whole, 1):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    stream = store.open_output_stream(draft, compression=None)
                    writer = Writer(stream, block, mode, level)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    writer.add(doc_id, encode(text or "") + end)
        if writer is not None:
            writer.close()
            stream.close()
            publish(store, draft, posixpath.join(base, name))
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [context.partitionId()], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.counts)]})

    ranged = df.select(id_col, text_col).repartitionByRange(F.col(id_col), F.xxhash64(text_col)).sortWithinPartitions(id_col, F.xxhash64(text_col), text_col)
    ranged = ranged.select(F.col(id_col).cast("string"), text_col)
    manifest = common.written(ranged.mapInArrow(common.releasing(write, tokenizing.forget), "file string, part long, n_docs long, n_ids long"), "token-manifest")
    return manifest.select(F.lit(path).alias("path"), "*", F.lit(df.schema[id_col].dataType.simpleString()).alias("id_type"))


def publish(store: fs.FileSystem, draft: str, name: str) -> None:
    """Gives a complete file its name, unless another attempt of the task has."""
    if store.get_file_info(name).type == fs.FileType.File:
        store.delete_file(draft)
    else:
        store.move(draft, name)


#: Tasks that read files back at most; each takes whole files.
READERS = 20_000


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """Per document, read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    One task reads one file, up to READERS tasks.  id_type is the manifest's
    unless given; an empty manifest has none, and its ids are longs.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    common.small_batches(spark)
    files = manifest.select("path", "file", before.alias("before"))  # a row a file, so the window is small
    total = manifest.agg(F.count(F.lit(1)), F.first("id_type")).first()
    kind = id_type.simpleString() if id_type else total[1] or "bigint"
    out = common.schema_of(("doc_id", T.StringType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(row["path"])
                name = posixpath.join(base, row["file"])
                with store.open_input_file(name) as stream:
                    r = Reader(stream, stream.size())
                    at = 0
                    while at < len(r.docs):
                        end = max(at + 1, int(np.searchsorted(r.starts, r.starts[at] + (1 << 20), "right")) - 1)
                        spans = list(zip(r.starts[at:end].tolist(), r.starts[at + 1 : end + 1].tolist()))
                        ids = [r.ids(a, b).tobytes() for a, b in spans]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.docs[at:end], pa.string()), pa.array([row["before"] + a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(ids, pa.binary())], names=out.names
                        )
                        at = end

    # A number of partitions of its own is not coalesced by the manifest's few bytes.
    dealt = files.repartition(max(1, min(READERS, total[0])))
    return dealt.mapInArrow(common.releasing(read), out).withColumn("doc_id", F.col("doc_id").cast(kind))
