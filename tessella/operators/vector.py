"""Exact cosine search, rank fusion, duplicate collapse, reranking and abstention."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.session import durable, shared_path, spread

# Candidates by channel, of the union, and for the reranker; fusion constant; results of an artifact; overlap of duplicates; weights of the blend.
LEXICAL, VECTOR, UNION, RERANK, RRF_K, PER_ARTIFACT, IOU, CROSS_WEIGHT, FUSION_WEIGHT = 64, 64, 96, 24, 60, 2, 0.80, 0.75, 0.25
#: Bytes of query vectors, and of the rows that a task keeps for them, that are searched at once; more are searched in blocks.
QUERY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def equality_filters(df: DataFrame, **values: object) -> DataFrame:
    """col = value for each value that is not None; array columns contain it."""
    kinds = dict(df.dtypes)
    tests = [F.array_contains(F.col(c), v) if kinds[c].startswith("array") else F.col(c) == v for c, v in values.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def ready(df: DataFrame, generation: str, profile: str) -> DataFrame:
    return df.where(F.col("ready") & F.col("catalog_current") & (F.col("generation") == generation) & (F.col("profile") == profile))


def knn(points: DataFrame, queries: DataFrame, *, k: int = VECTOR, id_col: str = "point_id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector", digits: int = 5) -> DataFrame:
    """query_id, id, score (cosine, rounded) and rank of each query's k nearest points; ties by id.

    A stated set of queries meets all points in blocks: each task keeps the k best
    of its own points for each query by matrix products.  There are as many tasks
    as cores at most, so at most cores * queries * k rows are shuffled.  Queries
    that, with the rows kept for them, take more than QUERY_BYTES are searched in
    blocks of at most that size, one after the other, each written to the shared
    folder; the driver holds one block.
    """
    rows = queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v"))
    size = rows.agg(F.sum(_held(F.size("v"), k))).first()[0] or 0
    q_type, p_type = rows.schema["q"].dataType, points.schema[id_col].dataType
    out = T.StructType([T.StructField("query_id", q_type), T.StructField("id", p_type), T.StructField("score", T.DoubleType())])
    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    near = _dealt(points.select(id_col, vector))
    if size <= QUERY_BYTES:
        named = rows.collect()  # bounded above
        if not named:
            return points.sparkSession.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
        return ranked(_search(near, named, out, k, digits)[0])
    base = shared_path(points.sparkSession, "knn")
    for named in _blocks(rows.toLocalIterator(), k):
        found, shared = _search(near, named, out, k, digits)
        found.write.mode("append").parquet(base)
        shared.destroy()
    return ranked(points.sparkSession.read.schema(out).parquet(base))


def _dealt(points: DataFrame) -> DataFrame:
    """points on all cores, and in no more parts: every part has its own k best of each query."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return spread(points).coalesce(cores)


def _held(dims, k: int):
    """Bytes of a query's vector and of the rows that a task keeps for it, two times k (see _search)."""
    return dims * 8 + 2 * k * 24


def _blocks(rows: Iterator[Row], k: int, size: Callable[[Row], int] | None = None) -> Iterator[list[Row]]:
    """The rows (q, v) in lists that take QUERY_BYTES at most (size of a row: see _held); a longer one is alone."""
    size = size or (lambda r: _held(len(r.v), k))
    block, held = [], 0
    for r in rows:
        if block and held + size(r) > QUERY_BYTES:
            yield block
            block, held = [], 0
        block.append(r)
        held += size(r)
    if block:
        yield block


class _Best:
    """The k best points so far of some queries, in order of score, then id: arrays of queries' places, scores and ids, cut down once they hold 2 k rows a query."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.floor, self.held, self.parts = n, k, np.full(n, -np.inf), 0, []

    def add(self, scores: np.ndarray, names: np.ndarray, digits: int | None, at: np.ndarray | None = None) -> None:
        """scores: queries by points, not rounded, -inf: no candidate; digits: None leaves them as they are; at: the places of these queries, where they are not all."""
        at = np.arange(self.n) if at is None else at
        floor = self.floor[at]
        # Scores that round up to the floor are less than a unit of the last digit below it.
        unit, rounded = (0.0, np.asarray) if digits is None else (10.0**-digits, lambda x: np.round(x, digits))
        reach = (scores >= floor[:, None] - unit).ravel().nonzero()[0]
        if len(reach) > 2 * len(at) * self.k and scores.shape[1] > self.k:
            # The k-th of these points is no better than the k-th of all.
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
            self.floor[at] = floor = np.fmax(floor, rounded(least))
            reach = (scores >= floor[:, None] - unit).ravel().nonzero()[0]
        q, p = np.divmod(reach, scores.shape[1])
        exact = rounded(scores.ravel()[reach]) + 0.0
        kept = (exact >= floor[q]) & (exact > -np.inf)
        self.parts.append((at[q[kept]].astype(np.int32), exact[kept], names[p[kept]]))
        self.held += int(kept.sum())
        if self.held > 2 * self.n * self.k:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
        q, score, name = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((name, -score, q))
        q, score, name = q[order], score[order], name[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, score, name = (x[place < self.k] for x in (q, score, name))
        last = place[place < self.k] == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.parts, self.held = [(q, score, name)], len(q)
        return q, score, name


#: Queries and points that are compared at once.
TILE = 1024


def _search(points: DataFrame, named: list[Row], out: T.StructType, k: int, digits: int) -> tuple[DataFrame, Broadcast]:
    """query_id, id and score of each task's k best points for each query, and the broadcast queries."""
    matrix = np.array([r.v for r in named], np.float64).reshape(len(named), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = points.sparkSession.sparkContext.broadcast((pa.array([r.q for r in named], to_arrow_type(out["query_id"].dataType)), matrix / np.where(norms == 0, 1, norms)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        best = [_Best(len(unit[i : i + TILE]), k) for i in range(0, len(unit), TILE)]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in (batch.slice(i, TILE) for i in range(0, batch.num_rows, TILE)):
                block = _units(_matrix(part.column(1)))
                finite = np.isfinite(block).all(axis=1)
                names, block = part.column(0).to_numpy(zero_copy_only=False)[finite], block[finite]
                for i, own in enumerate(best):
                    own.add(unit[i * TILE : (i + 1) * TILE] @ block.T, names, digits)
        for i, own in enumerate(best):
            q, score, name = own.cut()
            if len(q):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + i * TILE)), pa.array(name, kind), pa.array(score)], names=out.names)
            own.parts = []

    return points.mapInArrow(search, out), shared


def _search_lists(points: DataFrame, named: list[Row], out: T.StructType, k: int, digits: int) -> tuple[DataFrame, Broadcast]:
    """As _search, of points (id, v, list) whose list a query probes; named: q, v (bytes of a unit vector) and bits (of the lists)."""
    ids = pa.array([r.q for r in named], to_arrow_type(out["query_id"].dataType))
    matrix, bits = (np.frombuffer(b"".join(r[c] for r in named), kind).reshape(len(named), -1) for c, kind in (("v", np.float64), ("bits", np.uint8)))
    shared = points.sparkSession.sparkContext.broadcast((ids, matrix, bits))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, bits = shared.value
        best, kind = _Best(len(unit), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            names, block, lists = batch.column(0).to_numpy(zero_copy_only=False), _units(_matrix(batch.column(1))), batch.column(2).to_numpy()
            order = np.argsort(lists, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1) if len(order) else ():
                at = np.flatnonzero(bits[:, lists[own[0]] >> 3] & (128 >> (lists[own[0]] & 7)))
                for i in (at[i : i + TILE] for i in range(0, len(at), TILE)):
                    for j in (own[j : j + TILE] for j in range(0, len(own), TILE)):
                        best.add(unit[i] @ block[j].T, names[j], digits, i)
        q, score, name = best.cut()
        if len(q):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(name, kind), pa.array(score)], names=out.names)

    return points.mapInArrow(search, out), shared


#: Vectors of the sample that centroids are fitted on, points of a list, points that one file of a list holds, and the share of the nearest that probes shall find in the sample.
FIT, LIST, CHUNK, TARGET = 20_000, 1000, 50_000, 0.97


class PartitionIndex:
    """Points in lists by their nearest of some centroids; a search computes exact cosines inside the lists nearest to its query only.

    Centroids come from a bounded sample (FIT vectors, whole lists in turn), and so
    does the number of lists probed: the fewest by which the sample's own queries
    find TARGET of their nearest.  Every point is in a list, in parts of bounded
    size, and lists are directories, so that others are not read.
    """

    def __init__(self, points: DataFrame, path: str, *, k: int = 10, id_col: str = "point_id", vector: str = "vector"):
        self.spark, self.path, self.id_type = points.sparkSession, path, points.schema[id_col].dataType
        rows = points.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col(vector).isNotNull())
        n = rows.count()
        drawn = rows if n <= FIT else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * FIT // n).limit(2 * FIT)
        sample = _units(np.array([r.v for r in drawn.orderBy("id").collect()], np.float64).reshape(-1, len(drawn.first().v) if n else 1))
        self.centroids = _centroids(sample, max(1, min(len(sample), -(-n // LIST) if n > LIST * 16 else round(len(sample) ** 0.5))))
        self.probes = _probes(sample, self.centroids, k)
        shared, parts = self.spark.sparkContext.broadcast(self.centroids), max(1, -(-n // (CHUNK * len(self.centroids) or 1)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _tiles(batch, len(shared.value)):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_nearest(_units(_matrix(part.column(1))), shared.value), pa.int64())], names=["id", "v", "list"])

        out = T.StructType([*rows.schema.fields, T.StructField("list", T.LongType())])
        placed = rows.mapInArrow(place, out).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        placed.repartition("list", "part").write.partitionBy("list").parquet(path)

    def search(self, queries: DataFrame, k: int, *, probes: int | None = None, query_id: str = "query_id", vector: str = "vector", digits: int = 5) -> DataFrame:
        """query_id, id, score and rank of the k nearest points in the lists that are probed; all lists (probes: their number) give the exact result.

        A query has one row, with a bit for each list, whatever the number of lists it
        probes.  Queries are searched in blocks as in knn: points stay where they are
        read, and tasks keep the k best of their own.
        """
        most, shared = min(probes or self.probes, len(self.centroids)), self.spark.sparkContext.broadcast(self.centroids)
        asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _tiles(batch, len(shared.value)):
                    v = _units(_matrix(part.column(1)))
                    lists = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :most]
                    bits = np.zeros((len(v), len(shared.value)), np.uint8)
                    np.put_along_axis(bits, lists, 1, axis=1)
                    used = pa.array([np.unique(lists).astype(np.int32)] + [None] * (len(v) - 1), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()), used], names=["q", "v", "bits", "used"])

        kind = T.StructType([asked.schema["q"], T.StructField("v", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("used", T.ArrayType(T.IntegerType()))])
        met = durable(asked.mapInArrow(nearest, kind), "probes")
        lists = [r.list for r in met.select(F.explode("used").alias("list")).distinct().collect()]  # a number a list at most
        points = _dealt(self.spark.read.parquet(self.path).where(F.col("list").isin(lists)).select("id", "v", F.col("list").cast("long").alias("list")))
        out = T.StructType([T.StructField("query_id", asked.schema["q"].dataType), T.StructField("id", self.id_type), T.StructField("score", T.DoubleType())])
        ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        rows, size = met.select("q", "v", "bits"), lambda r: _held(len(r.v) // 8, k) + len(r.bits)
        if (rows.agg(F.sum(_held(F.octet_length("v") / 8, k) + F.octet_length("bits"))).first()[0] or 0) <= QUERY_BYTES:
            named = rows.collect()  # bounded above
            if not named:
                return self.spark.createDataFrame([], T.StructType([*out.fields, T.StructField("rank", T.IntegerType())]))
            return ranked(_search_lists(points, named, out, k, digits)[0])
        base = shared_path(self.spark, "probed")
        for named in _blocks(rows.toLocalIterator(), k, size):
            found, block = _search_lists(points, named, out, k, digits)
            found.write.mode("append").parquet(base)
            block.destroy()
        return ranked(self.spark.read.schema(out).parquet(base))


def _tiles(batch: pa.RecordBatch, width: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that a matrix with `width` numbers a row has about `most`."""
    step = max(1, most // max(1, width))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), -1)


def _units(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True) if len(v) else np.ones((0, 1))
    return v / np.where(norm > 0, norm, 1)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Each vector's nearest centroid, some vectors at a time."""
    step = max(1, (1 << 20) // len(centroids))
    return np.concatenate([(v[i : i + step] @ centroids.T).argmax(axis=1) for i in range(0, len(v), step)] or [np.zeros(0, np.int64)])


def _centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced vectors of the sample; empty lists keep their centroid."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    at = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        near = _nearest(sample, at)
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        at = np.where(np.bincount(near, minlength=n)[:, None] > 0, _units(total), at)
    return at


def _probes(sample: np.ndarray, centroids: np.ndarray, k: int, queries: int = 200) -> int:
    """The fewest lists by which evenly spaced vectors of the sample find TARGET of their k nearest in it."""
    if not len(sample):
        return 1
    asked = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    home = _nearest(sample, centroids)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(TARGET * len(needed)))]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries and the share of their exact neighbours that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def fuse(vector: DataFrame, lexical: DataFrame, *, id_col: str = "id", limit: int = UNION) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: query_id, id, vector_rank, lexical_rank, fusion_score and fusion_rank.

    Ranks are those before the join, so a hit that is dropped leaves a gap.
    """
    v = vector.select("query_id", id_col, F.col("rank").alias("vector_rank"))
    l = lexical.select("query_id", id_col, F.col("rank").alias("lexical_rank"))
    share = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = v.join(l, ["query_id", id_col], "full").withColumn("fusion_score", share("vector_rank") + share("lexical_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), id_col)
    return both.withColumn("fusion_rank", F.row_number().over(order)).where(F.col("fusion_rank") <= limit)


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over the hull of two intervals."""
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)) / hull).otherwise(F.lit(0.0))


def iou_pairs(spans: DataFrame, key: str, span: str, start: str, end: str, *, least: float = IOU) -> DataFrame:
    """key, a, b: the pairs of spans of a key, a < b, whose IoU is `least` or more.

    The hull of such a pair is at most the shorter one's length / least, and starts
    differ by (1 - least) of it at most.  So spans are put into cells by class of
    length (powers of 1 / least) and by start, and the shorter of a pair looks into
    the few cells of its own class and the next that the longer can be in.  Spans
    without length overlap with nothing; null keys and ends have no pairs.
    """
    rows = spans.select(F.col(key).alias("key"), F.col(span).alias("id"), F.col(start).alias("s"), F.col(end).alias("e")).withColumn("l", F.col("e") - F.col("s")).where("key is not null and l > 0")
    near = _met(rows, least).where(iou(F.col("sx"), F.col("ex"), F.col("sy"), F.col("ey")) >= least).where("x <> y")
    return near.select(F.col("key").alias(key), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _met(rows: DataFrame, least: float) -> DataFrame:
    """The candidates of iou_pairs: pairs x, y of a key that share a cell, x the shorter."""
    step, slack = math.log(1 / least), (1 - least) / least
    rows = rows.withColumn("class", F.floor(F.log("l") / step))
    # A cell is half as wide as starts of its class can differ.
    cell = lambda place, kind: F.floor(place / (slack / 2 * F.exp((kind + 1) * step)))
    longer = rows.select("key", F.col("id").alias("y"), F.col("s").alias("sy"), F.col("e").alias("ey"), F.col("l").alias("ly"), "class", cell(F.col("s"), F.col("class")).alias("cell"))
    # Logarithms are rounded: lengths are widened by more than that.
    probes = rows.withColumn("other", F.explode(F.sequence(F.floor(F.log(F.col("l") * (1 - 1e-9)) / step), F.floor(F.log(F.col("l") / least * (1 + 1e-9)) / step))))
    reach = F.col("l") * slack * (1 + 1e-9)
    probes = probes.select("key", F.col("id").alias("x"), F.col("s").alias("sx"), F.col("e").alias("ex"), F.col("l").alias("lx"), F.col("other").alias("class"), F.explode(F.sequence(cell(F.col("s") - reach, F.col("other")), cell(F.col("s") + reach, F.col("other")))).alias("cell"))
    return probes.join(longer, ["key", "class", "cell"]).where((F.col("lx") < F.col("ly")) | ((F.col("lx") == F.col("ly")) & (F.col("x") < F.col("y"))))


def collapse(ranked: DataFrame, *, threshold: float = IOU) -> DataFrame:
    """Greedy collapse in rank order: query_id, id, rank and alternates of the rows that stay.

    Takes query_id, id, rank, revision_id, span_sha256, start, end, of 96 rows a
    query at most.  A row joins the first row that stays of which it is the same
    copy or, in the same revision, overlaps enough; it is a fold, not a grouping.
    """
    fields = ["rank", "id", "revision_id", "span_sha256", "start", "end"]
    row = F.struct(*fields)
    kind = T.StructType([ranked.select(*fields).schema[f] for f in fields])
    kept = T.ArrayType(T.StructType([T.StructField("row", kind), T.StructField("alternates", T.ArrayType(ranked.schema["id"].dataType))]))

    def same(x: Column, y: Column) -> Column:
        copy = (x["span_sha256"] == y["span_sha256"]) & (x["start"] == y["start"]) & (x["end"] == y["end"])
        return copy | ((x["revision_id"] == y["revision_id"]) & (iou(x["start"], x["end"], y["start"], y["end"]) >= threshold))

    def step(acc: Column, x: Column) -> Column:
        first = F.array_position(F.transform(acc, lambda k: same(k["row"], x)), F.lit(True))
        joined = F.transform(acc, lambda k, i: F.when(i + 1 == first, F.struct(k["row"].alias("row"), F.array_append(k["alternates"], x["id"]).alias("alternates"))).otherwise(k))
        fresh = F.struct(x.alias("row"), F.array().cast(kept.elementType["alternates"].dataType).alias("alternates"))
        return F.when(first > 0, joined).otherwise(F.array_append(acc, fresh))

    folded = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).select("query_id", F.aggregate("rows", F.array().cast(kept), step).alias("kept"))
    return folded.select("query_id", F.explode("kept").alias("k")).select("query_id", F.col("k.row.id").alias("id"), F.col("k.row.rank").alias("rank"), F.col("k.alternates").alias("alternates"))


Reranker = Callable[[str, Sequence[str]], Sequence[float]]


def rerank(ranked: DataFrame, scorer: Reranker, *, most: int = RERANK, place: str = "fusion_rank") -> DataFrame:
    """ranked (query_id, query, id, content, fusion_rank) with cross_score, cross_rank and final_rank.

    The scorer sees each query's first `most` rows by `place`; they are ordered by the
    blend of both ranks, the others follow.  A scorer must give a finite score
    for every row.
    """
    schema = T.StructType([ranked.schema["query_id"], ranked.schema["id"], T.StructField("cross_score", T.DoubleType())])

    def score(pdf):
        pdf = pdf.sort_values("fusion_rank")
        got = [float(x) for x in scorer(pdf["query"].iloc[0], pdf["content"].tolist())]
        if len(got) != len(pdf) or not np.isfinite(got).all():
            raise ValueError("the reranker must give a finite score for every row")
        return pdf[["query_id", "id"]].assign(cross_score=got)

    head = ranked.where(F.col(place) <= most)
    scored = head.groupBy("query_id").applyInPandas(score, schema)
    crossed = scored.withColumn("cross_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cross_score"), "id")))
    out = ranked.join(crossed, ["query_id", "id"], "left")
    blend = CROSS_WEIGHT / (RRF_K + F.col("cross_rank")) + FUSION_WEIGHT / (RRF_K + F.col("fusion_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("cross_rank").isNull(), F.desc(blend), "fusion_rank", "id")
    return out.withColumn("final_score", blend).withColumn("final_rank", F.row_number().over(order))


def cap(ranked: DataFrame, group: str, *, most: int = PER_ARTIFACT, verified: Column | None = None, rank: str = "rank") -> DataFrame:
    """The first `most` verified rows of each query and group."""
    rows = ranked.where(verified) if verified is not None else ranked
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", group).orderBy(rank))).where(F.col("__n") <= most).drop("__n")


def margins(ranked: DataFrame, score: str = "score") -> DataFrame:
    """query_id, top_score and margin (null with one row) of each query's first two rows."""
    return ranked.where("rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top_score"), (F.max(F.when(F.col("rank") == 1, F.col(score))) - F.max(F.when(F.col("rank") == 2, F.col(score)))).alias("margin"))


def abstention(has: Column, cross: Column, margin: Column, exact: Column, agree: Column, exact_min, agreement_min, single_min, margin_min) -> Column:
    """Null to answer, else why not: no-candidate, reranker-unavailable, below-calibrated-threshold."""
    wide = F.coalesce(margin >= margin_min, F.lit(False))
    answer = (exact & (cross >= exact_min)) | (agree & (cross >= agreement_min) & wide) | ((cross >= single_min) & wide)
    return F.when(~has, "no-candidate").when(cross.isNull(), "reranker-unavailable").when(~answer, "below-calibrated-threshold")
