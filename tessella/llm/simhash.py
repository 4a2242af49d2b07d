"""SimHash near duplicates by vantage-point trees.

Of two 64-bit fingerprints that differ in at most 2r + 1 bits, one half differs
in at most r (3 bits: one in a half).  So there is a tree a half, over the Hamming
distance of that half: a node splits fingerprints by their distance to a vantage
point, and a query with radius r goes into the branches that the triangle
inequality leaves, which are both for the two distances next to the split only.

The upper levels are fitted on a bounded sample and shared by all tasks; their
leaves are shards.  Each distinct fingerprint is at home in one shard of a tree
and visits the shards whose boundary is within r of it.  A task grows the rest of
the tree over its shard's fingerprints, compares whole fingerprints in its
leaves, and hands on the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import common, graph

#: Fingerprints of the sample that the upper levels are fitted on, and of it in a shard at least.
SAMPLE, LEAST_SAMPLED = 1 << 18, 16
#: Fingerprints at home in a shard, about; and in a leaf of a task's own tree.
SHARD, LEAF = 8192, 48
#: Cells of a comparison made at once; words of a text hashed at once.
CELLS, WORDS = 1 << 22, 1 << 17
HALVES = (0xFFFFFFFF, 0xFFFFFFFF << 32)
SEED = 42


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash over the XXH64 of all `size`-word shingles, repeats included; 0 without words.

    A-Z are lower-cased; words lie between ASCII white space; fewer than `size`
    words make one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, WORDS):
        part = words[a : a + WORDS + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id and fp (the fingerprint's bits as a long) of every row."""
    out = common.schema_of(common.field(df, id_col), ("fp", T.LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.text_slices(whole, 1):
                made = np.array([fingerprint(t, size) for t in part.column(1).cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made.view(np.int64))], names=out.names)

    return common.spread(df.select(id_col, text_col)).mapInArrow(common.releasing(work), out)


def distance(a: np.ndarray, b, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask))


def split(points: np.ndarray, mask: int) -> tuple[np.uint64, int] | None:
    """A vantage point, and the distance up to which points are inside: about half of them; None if points do not differ in the mask."""
    for at in (len(points) // 2, 0, len(points) - 1):
        d = distance(points, points[at], mask)
        counts = np.cumsum(np.bincount(d, minlength=65))
        # The split that leaves the larger side smallest.
        cut = int(np.argmin(np.maximum(counts, len(points) - counts)))
        if 0 < counts[cut] < len(points):
            return points[at], cut
    return None


def plan(mask: int, radius: int, most: int) -> tuple[int, int] | None:
    """The mask and radius to go on with where points do not differ in a mask: the whole fingerprint, then none."""
    return None if mask == HALVES[0] | HALVES[1] else (HALVES[0] | HALVES[1], most)


def grow(points: np.ndarray, mask: int, radius: int, most: int, leaf: int) -> list[tuple]:
    """Nodes of a tree over the sample: (vantage, mask, cut, radius, inside, outside), children by place; a shard's is (-1 - its number)."""
    nodes: list = []
    shards = 0

    def add(part: np.ndarray, mask: int, radius: int) -> int:
        nonlocal shards
        while len(part) > leaf:
            if made := split(part, mask):
                place = len(nodes)
                nodes.append(None)
                inside = distance(part, made[0], mask) <= made[1]
                low = add(part[inside], mask, radius)
                nodes[place] = (int(made[0]), mask, made[1], radius, low, add(part[~inside], mask, radius))
                return place
            if not (further := plan(mask, radius, most)):
                break
            mask, radius = further
        shards += 1
        return -shards

    root = add(points, mask, radius)
    return [root, *nodes]


def route(tree: list, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, places of points, which of them are at home) of every shard that points visit."""
    stack = [(tree[0], np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        at, rows, home = stack.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -1 - at, rows, home
            continue
        vantage, mask, cut, radius, low, high = tree[1 + at]
        d = distance(points[rows], np.uint64(vantage), mask).astype(np.int64)
        near, far = d <= cut + radius, d >= cut + 1 - radius
        stack.append((low, rows[near], (home & (d <= cut))[near]))
        stack.append((high, rows[far], (home & (d > cut))[far]))


class Forest:
    """Classes of linked places, named by their smallest; whole arrays of links are added at once."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while len(far := np.flatnonzero(up[x] != up[up[x]])):
            up[x[far]] = up[up[x[far]]]
        return up[x]

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.top(x), self.top(y)
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def search(points: np.ndarray, home: np.ndarray, mask: int, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of points at home, places of any): the pairs that differ in at most `most` bits, by a tree over the points at home."""
    stack = [(np.flatnonzero(home), np.arange(len(points)), mask, radius)]
    while stack:
        own, all_, mask, radius = stack.pop()
        if not len(own) or not len(all_):
            continue
        made = split(points[own], mask) if len(own) > LEAF else None
        if made is None and len(own) > LEAF and (further := plan(mask, radius, most)):
            stack.append((own, all_, *further))
            continue
        if made is None:
            step = max(1, CELLS // len(all_))
            for a in range(0, len(own), step):
                x, y = np.nonzero(np.bitwise_count(points[own[a : a + step], None] ^ points[all_][None, :]) <= most)
                x, y = own[a + x], all_[y]
                if len(other := np.flatnonzero(x != y)):
                    yield x[other], y[other]
            continue
        vantage, cut = made
        d, e = distance(points[own], vantage, mask).astype(np.int64), distance(points[all_], vantage, mask).astype(np.int64)
        stack.append((own[d <= cut], all_[e <= cut + radius], mask, radius))
        stack.append((own[d > cut], all_[e >= cut + 1 - radius], mask, radius))


def links(points: DataFrame, most: int) -> DataFrame:
    """a, b: a spanning forest, shard by shard, of the fingerprints (distinct, column fp) that differ in at most `most` bits."""
    if most % 2 == 0:
        raise ValueError("the halves share an odd number of bits evenly")
    spark, radius = points.sparkSession, most // 2
    n = points.count()
    scale = 1 << 30
    chance = min(scale, max(1, scale * SAMPLE // max(n, 1)))
    # A hash chooses the sample: the same one whenever a task runs again.
    sampled = points if n <= SAMPLE else points.where(F.pmod(F.xxhash64("fp"), F.lit(scale)) < chance)
    drawn = np.sort(np.fromiter((r.fp for r in sampled.select("fp").toLocalIterator()), np.int64).view(np.uint64))
    # Neighbours in number share their upper bits: the sample is mixed so that its middle is any point.
    drawn = drawn[np.argsort(drawn * np.uint64(0x9E3779B97F4A7C15), kind="stable")]
    leaf = max(LEAST_SAMPLED, SHARD * len(drawn) // max(n, 1))
    trees = spark.sparkContext.broadcast([grow(drawn, m, radius, most, leaf) for m in HALVES])  # a node a shard, SAMPLE / LEAST_SAMPLED of them at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for half, tree in enumerate(trees.value):
                for shard, rows, home in route(tree, values.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), 2 * shard + half, np.int64)), pa.array(values[rows]), pa.array(home)], names=["shard", "fp", "home"])

    def compare(shard: pa.Table) -> pa.Table:
        values, home = shard["fp"].to_numpy(), shard["home"].to_numpy()
        order = np.argsort(values, kind="stable")
        values, home = values[order], home[order]
        forest = Forest(len(values))
        linked = np.zeros(len(values), bool)
        for x, y in search(values.view(np.uint64), home, HALVES[shard["shard"][0].as_py() % 2], radius, most):
            linked[x] = linked[y] = True
            forest.join(x, y)
        a = np.flatnonzero(linked)
        b = forest.top(a)
        a, b = a[a != b], b[a != b]
        return pa.table({"a": values[a], "b": values[b]})

    dealt = points.select("fp").mapInArrow(common.releasing(deal), "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(compare, "a long, b long")


def simhash_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 3) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits) and component_id (smallest id reachable by links, itself included) of every row.

    Rows link when their fingerprints differ in at most `most` bits.  Null, empty
    and blank texts have fingerprint 0, which links like any other.  Rows that
    repeat an id are rows of their own.  A null id is passed over as a component's
    smallest, which is null only where all its ids are.  An empty table gives no
    rows; other columns are ignored.  Whole texts are hashed, 131,072 words at a
    time.
    """
    common.small_batches(df.sparkSession)
    rows = common.written(fingerprints(df, id_col, text_col, size).withColumnRenamed(id_col, "__id"), "fingerprints")
    points = common.written(rows.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("times")), "points")
    named = graph.components(links(points, most)).select(F.col("node").alias("fp"), "component")
    classes = common.written(points.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = common.written(classes.select("fp", "times", "component").join(least, "component").select("fp", "times", "component_id"), "placed")
    # Fingerprints that a thousandth of the rows share, of which there are a thousand at most, by broadcast; the rest by a shuffle.
    total = placed.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    floor = max(2, -(-total // 1000))
    heavy = placed.where(F.col("times") >= floor).select("fp", F.lit(True).alias("__heavy"), F.col("component_id").alias("__own"))
    marked = rows.join(F.broadcast(heavy), "fp", "left")
    light = marked.where("__heavy is null").select("__id", "fp").join(placed.where(F.col("times") < floor), "fp").select("__id", "fp", "component_id")
    both = light.unionByName(marked.where("__heavy").select("__id", "fp", F.col("__own").alias("component_id")))
    return both.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
