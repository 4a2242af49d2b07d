"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents are cut into whole windows plus a remainder; remainders are cut into
chunks and differenced, group by group, into windows of near-equal fill.  Both
steps run inside the scan's own tasks, so nothing is shuffled and a lost
executor only repeats its splits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import common, tokenizing

#: Sequence numbers: this many per partition of the scan.
SEQUENCES_PER_PARTITION = 1 << 40
#: Pieces below this many ids are differenced in bundles of up to as many; so many fine cuts of a group are not, as they level its windows.
BUNDLE, LOOSE = 64, 4096
#: Rows of a batch that leaves a worker, 8 KB each at most for windows of 2048 ids.
ROWS = 1000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k-1, of each item by multiway largest differencing.

    Every item starts as a partial partition (size, 0, ..., 0).  The two partial
    partitions of largest spread are merged again and again, the fullest window
    of one with the emptiest of the other, and the common fill is taken off.
    """
    n = len(sizes)
    if k <= 1 or n == 0:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    nodes = n
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes.tolist()):
        fill, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        fill[0], node[0] = size, i
        heap.append((-size, i, fill, node))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a_fill, a_node = heapq.heappop(heap)
        _, _, b_fill, b_node = heapq.heappop(heap)
        b_fill, b_node = b_fill[::-1], b_node[::-1]
        fill, node = a_fill + b_fill, np.where(a_node < 0, b_node, a_node)
        both = np.flatnonzero((a_node >= 0) & (b_node >= 0))
        if len(both):
            made = np.arange(nodes, nodes + len(both))
            left[made], right[made], node[both] = a_node[both], b_node[both], made
            nodes += len(both)
        by_fill = np.argsort(-fill, kind="stable")
        fill, node = fill[by_fill], node[by_fill]
        fill -= fill[-1]
        heapq.heappush(heap, (-int(fill[0]), order, fill, node))
        order += 1
    window = np.zeros(n, np.int64)
    for w, root in enumerate(heap[0][3].tolist()):
        stack = [root] if root >= 0 else []
        while stack:
            at = stack.pop()
            if at < n:
                window[at] = w
            else:
                stack += [int(left[at]), int(right[at])]
    return window


def windows(sizes: np.ndarray, capacity: int, spare: float) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows): the count rises until none exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // max(1, int(capacity * (1 - spare)))))
    while True:
        window = differencing(sizes, k)
        if not len(sizes) or np.bincount(window, sizes, k).max() <= capacity:
            return window, k
        k += max(1, k // 200)


def chunks(length: int, most: int, fine: bool) -> list[int]:
    """A remainder's cuts; a fine one also gives small chunks, which level the windows at the end."""
    out = []
    if fine:
        for size in (1, 2, 3, 5, 8, 12, 18, 27, 40, 60):
            if length > size:
                out.append(size)
                length -= size
    parts = -(-length // most)
    return out + [(length + i) // parts for i in range(parts)]


class _Group:
    """Remainders of one partition until they fill `windows_a_group` windows.

    Differencing holds a window's worth of numbers for every item, so small pieces
    go in bundles: of documents of one id too there are some 16,000 items a group.
    """

    def __init__(self, capacity: int, most: int, fine_every: int, spare: float):
        self.capacity, self.most, self.fine_every, self.spare = capacity, most, fine_every, spare
        self.seen = 0
        self.clear()

    def clear(self) -> None:
        self.items: list[list[tuple[Any, int, bytes, int]]] = []
        self.sizes: list[int] = []
        self.total = self.loose = 0
        self.open = -1

    def add(self, doc_id: Any, start: int, ids: bytes, doc_tokens: int) -> None:
        length, at = len(ids) // 4, 0
        fine = self.seen % self.fine_every == 0
        for size in chunks(length, self.most, fine):
            self.put((doc_id, start + at, ids[4 * at : 4 * (at + size)], doc_tokens), size, fine)
            at += size
        self.seen += 1
        self.total += length

    def put(self, piece: tuple[Any, int, bytes, int], size: int, fine: bool) -> None:
        loose = fine and self.loose < LOOSE
        self.loose += loose
        small = size < BUNDLE and not loose
        if small and self.open >= 0 and self.sizes[self.open] + size <= BUNDLE:
            self.items[self.open].append(piece)
            self.sizes[self.open] += size
            return
        if small:
            self.open = len(self.items)
        self.items.append([piece])
        self.sizes.append(size)

    def flush(self) -> tuple[Iterator[tuple[Any, int, bytes, int, int, int]], int]:
        """(piece, window, offset) rows and the number of windows."""
        window, k = windows(np.asarray(self.sizes, np.int64), self.capacity, self.spare)
        items = self.items
        self.clear()

        def rows() -> Iterator[tuple[Any, int, bytes, int, int, int]]:
            offset = [0] * k
            for item, w in zip(items, window.tolist()):
                for piece in item:
                    yield (*piece, w, offset[w])
                    offset[w] += len(piece[2]) // 4

        return rows(), k


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    windows_a_group: int = 256,
    most: int = 1024,
    fine_every: int = 8,
    spare: float = 0.003,
) -> DataFrame:
    """Pieces of documents with their window: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null or empty text gives end_id alone.
    Every id lies in one piece; a window holds capacity ids at most.  Whole
    windows of a long document are sequences of their own.  Rows repeated, or
    with one id, are documents of their own; null ids stay null; an empty table
    gives no rows; other columns are ignored.
    """
    common.small_batches(df.sparkSession)
    out = common.schema_of(common.field(df, id_col), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizing.encoder(tokenizer).encode, np.asarray([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION
        group, rows, kind = _Group(capacity, most, fine_every, spare), [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * 7
            types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=out.names)
            rows.clear()
            return made

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            placed, k = group.flush()
            for d, s, i, n, w, o in placed:
                rows.append((d, s, len(i) // 4, i, n, sequence + w, o))
                if len(rows) > ROWS:
                    yield batch()
            sequence += k

        for whole in batches:
            kind = whole.schema.field(0).type
            for part in common.text_slices(whole, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    full = n // capacity * capacity
                    for start in range(0, full, capacity):
                        rows.append((doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], n, sequence, 0))
                        sequence += 1
                        if len(rows) > ROWS:
                            yield batch()
                    if full < n:
                        group.add(doc_id, full, ids[4 * full :], n)
                    if group.total >= windows_a_group * capacity:
                        yield from flush()
                    if len(rows) > ROWS:
                        yield batch()
        if group.items:
            yield from flush()
        if rows:
            yield batch()

    return common.spread(df.select(id_col, text_col)).mapInArrow(common.releasing(pack, tokenizing.forget), out)
