"""An inverted index that outlives a query: postings by term bucket and block of documents, appended by revision.

The folder has three tables, each partitioned by revision:

* postings: a row a term and block of documents, in the files of the term's bucket
  (a bucket of its own has the lengths of each block's documents),
  with the block's documents and their frequencies, counts for the document
  frequencies, and bounds (largest frequencies, least length) for the scores.
* docs: each document's title and length, and the revision it belongs to.
* stale: documents of earlier revisions that a later one replaces or removes.

A search reads the files of its terms' buckets only.  From the bounds alone it
knows what a query can score at most in each block; each query's most promising
blocks are scored first, and of the others only those whose bound reaches the k-th
score so far.  The result is that of scoring everything.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.functions import text as X
from tessella.operators import search as S
from tessella.session import durable, small_batches, text_slices

#: Documents of a block; documents of a revision for each set of term buckets; blocks whose postings share a file; blocks that a query scores first.
BLOCK, BUCKETS, PER_BUCKETS, TOGETHER, FIRST = 4096, 32, 1_000_000, 32, 8
#: The bucket of the rows without a term, which have the lengths of a block's documents.
LENGTHS = -1
#: Scores are compared after rounding to 6 decimals.
MARGIN = 1e-5


def blocks_of(docs: DataFrame, blocks: int, *, id_col: str = "doc_id", title: str = "title", content: str = "content", extra: dict[str, float] | None = None) -> DataFrame:
    """term, block, counts, bounds and docs (see _postings) of each term and block, and a row a block without a term, with the lengths of its documents.

    tf counts the content; boosted: the title, or a part of a hyphenated word of
    it, has the term; indexed: content or title have it.  weight adds up the
    columns' BM25 weights, len counts a document's tokens.  extra: columns that are
    one token each, with their weights.  Texts are dealt by block, and a task
    counts one block at a time, so what it holds does not grow with the documents.
    """
    extra = dict(zip(("source", "lang"), S.BM25_WEIGHTS)) if extra is None else extra
    heading, body = S.BM25_WEIGHTS[2:]
    small_batches(docs.sparkSession)
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(block.alias("block"), F.col(id_col).alias("doc_id"), *{title, content, *extra}).repartition(max(least, blocks), "block").sortWithinPartitions("block")
    rows = dealt.select(F.lower(content).alias("content"), F.lower(title).alias("title"), F.array(*(F.lower(c) for c in extra)).cast("array<string>").alias("extra"), "block", "doc_id")
    out = T.StructType.fromDDL(_row(docs.schema[id_col].dataType.simpleString())[: -len(", revision int, bucket int")])
    kinds = to_arrow_schema(out)
    weights = list(extra.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for part in text_slices(batch, 0):
                texts, titles = (part.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
                for text, name, one, block, doc in zip(texts, titles, *(part.column(i).to_pylist() for i in (2, 3, 4))):
                    if block != at:
                        if held:
                            yield from held.rows(at, kinds)
                        at, held = block, _Block()
                    held.add(doc, _counted(text), _counted(name), [(t.encode(), w) for t, w in zip(one, weights) if t is not None], body, heading)
        if held:
            yield from held.rows(at, kinds)

    return rows.mapInArrow(count, out)


#: Postings of a batch that goes back to Spark.
SENT = 1 << 17
#: text.tokenize on the bytes of a lower-case text: what ends a token is a blank, each byte of other characters too.
_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789-"
_ENDS = bytes(c if c in _LETTERS else ord("-") if c == ord("_") else 32 for c in range(256))
_STOP = frozenset(w.encode() for w in X.STOP_WORDS)


def _counted(low: bytes | None) -> dict[bytes, int]:
    """The tokens of a lower-case text and how often it has them."""
    return {t: n for t, n in Counter((low or b"").translate(_ENDS).split()).items() if len(t) > 1 and t not in _STOP}


class _Block:
    """The postings of one block of documents, in arrays: places of terms and documents, frequencies, marks and weights.  Rows of one id are one document."""

    def __init__(self):
        self.terms, self.docs = {}, {}
        self.parts = {name: array(kind) for name, kind in (("term", "l"), ("doc", "l"), ("tf", "l"), ("mark", "b"), ("weight", "d"), ("n", "l"))}

    def _put(self, doc: int, counts: dict[bytes, int], mark: int, weight: float, tf: bool = False, n: bool = True) -> None:
        """mark: 1 if the term makes a candidate, 2 if it is in the title or a part of it."""
        k, p, known = len(counts), self.parts, self.terms
        p["term"].extend([known.setdefault(t, len(known)) for t in counts])
        p["doc"].extend([doc] * k)
        p["tf"].extend(counts.values() if tf else [0] * k)
        p["mark"].extend([mark] * k)
        p["weight"].extend([weight * c for c in counts.values()])
        p["n"].extend(counts.values() if n else [0] * k)

    def add(self, doc, content: dict[bytes, int], title: dict[bytes, int], extra: list[tuple[bytes, float]], body: float, heading: float) -> None:
        at = self.docs.setdefault(doc, len(self.docs))
        self._put(at, content, 1, body, tf=True)
        self._put(at, title, 1, heading)
        self._put(at, {p: 1 for t in title for p in (t, *t.split(b"-")) if len(p) > 1}, 2, 0.0, n=False)
        for t, w in extra:
            self._put(at, {t: 1}, 0, w)

    def rows(self, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        term, doc, tf, mark, weight, n = (np.frombuffer(p, p.typecode) if len(p) else np.zeros(0, p.typecode) for p in self.parts.values())
        names, ids = pa.array(list(self.terms), pa.binary()).cast(pa.string()), pa.array(list(self.docs), schema.field("docs").type.value_type.field(0).type)
        lens = np.bincount(doc, n, len(self.docs)).astype(np.int64)
        order = np.lexsort((doc, term))
        term, doc, tf, mark, weight = (x[order] for x in (term, doc, tf, mark, weight))
        first = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(doc) != 0)]) if len(term) else np.zeros(0, np.int64)
        if len(first):
            term, doc, tf, mark, weight = term[first], doc[first], np.add.reduceat(tf, first), np.bitwise_or.reduceat(mark, first), np.add.reduceat(weight, first)
        boosted, indexed, size = (mark & 2) > 0, (mark & 1) > 0, lens[doc]
        starts = np.flatnonzero(np.r_[True, np.diff(term) != 0]) if len(term) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(term)]
        kind = schema.field("docs").type.value_type
        made = lambda a, b: pa.StructArray.from_arrays([ids.take(pa.array(doc[a:b])), pa.array(tf[a:b], pa.int64()), pa.array(boosted[a:b]), pa.array(indexed[a:b]), pa.array(weight[a:b]), pa.array(size[a:b])], fields=list(kind))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SENT, "right")))
            a, b, cuts = starts[i], ends[j - 1], starts[i:j] - starts[i]
            yield pa.RecordBatch.from_arrays([
                names.take(pa.array(term[starts[i:j]])), pa.array(np.full(j - i, block), pa.int64()), pa.array(np.add.reduceat(indexed[a:b].astype(np.int64), cuts)), pa.array(np.add.reduceat((weight[a:b] > 0).astype(np.int64), cuts)),
                pa.array(np.maximum.reduceat(tf[a:b] + S.TITLE_BOOST * boosted[a:b], cuts)), pa.array(np.maximum.reduceat(weight[a:b], cuts)), pa.array(np.minimum.reduceat(size[a:b], cuts)),
                pa.ListArray.from_arrays(pa.array(np.r_[cuts, b - a], pa.int32()), made(a, b), type=schema.field("docs").type),
            ], schema=schema)
            i = j
        everyone = [ids, *(pa.array([v] * len(lens), t.type) for v, t in zip((0, False, False, 0.0), list(kind)[1:5])), pa.array(lens)]
        own = pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), pa.StructArray.from_arrays(everyone, fields=list(kind)), type=schema.field("docs").type)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([block], pa.int64()), *(pa.array([0], pa.int64()),) * 3, pa.array([0.0]), pa.array([0], pa.int64()), own], schema=schema)


def _read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


#: What a posting has besides its document.
POSTING = {"tf": "long", "boosted": "boolean", "indexed": "boolean", "weight": "double", "len": "long"}


def _row(doc_id: str, fields: tuple[str, ...] = tuple(POSTING)) -> str:
    """The columns of the posting table; doc_id: the ids' type; fields: those of POSTING that are read."""
    one = f"struct<doc_id: {doc_id}, " + ", ".join(f"{f}: {POSTING[f]}" for f in fields) + ">"
    return f"term string, block long, n_indexed long, n_weighted long, most_tf long, most_weight double, least_len long, docs array<{one}>, revision int, bucket int"


def _postings(spark: SparkSession, path: str, doc_id: str, fields: tuple[str, ...] = tuple(POSTING)) -> DataFrame:
    """The posting table, which has no files where no document has a term; doc_id: the ids' type."""
    return spark.read.schema(_row(doc_id, fields)).parquet(f"{path}/postings")


def revisions(spark: SparkSession, path: str) -> list[int]:
    """The revisions whose tables are complete, as a row a revision says; others are not read."""
    done = _read(spark, path, "done")
    return sorted(r.revision for r in done.select("revision").distinct().collect()) if done is not None else []


def append(docs: DataFrame, path: str, revision: int, *, removed: DataFrame | None = None, id_col: str = "doc_id", title: str = "title", content: str = "content", extra: dict[str, float] | None = None) -> None:
    """Adds a revision: new documents, others that replace those of the same id, and ids (column doc_id) that go.

    Earlier files stay as they are.  A revision that is complete is not written
    again; one that was broken off is overwritten.
    """
    spark = docs.sparkSession
    before = revisions(spark, path)
    if revision in before:
        return
    n = docs.count()
    blocks, buckets = max(1, -(-n // BLOCK)), BUCKETS * max(1, -(-n // PER_BUCKETS))
    made = blocks_of(docs, blocks, id_col=id_col, title=title, content=content, extra=extra)
    made = made.withColumns({"bucket": F.when(F.col("term").isNull(), LENGTHS).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int"), "part": (F.col("block") / TOGETHER).cast("long")})
    # A common term's blocks lie in several files, and there are as many tasks as files, so no task holds more as documents grow.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.repartition(max(least, buckets * -(-blocks // TOGETHER)), "bucket", "part")
    dealt.drop("part").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/revision={revision}")
    own = _postings(spark, path, docs.schema[id_col].dataType.simpleString()).where((F.col("revision") == revision) & (F.col("bucket") == LENGTHS))
    lengths = own.select(F.explode("docs").alias("d")).select("d.doc_id", "d.len")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(title).alias("title")).join(lengths, "doc_id", "left").na.fill(0, ["len"])
    named.write.mode("overwrite").parquet(f"{path}/docs/revision={revision}")
    if before:
        old = live_docs(spark, path).select("doc_id", F.col("revision").alias("stale_in"))
        gone = named.select("doc_id") if removed is None else named.select("doc_id").unionByName(removed.select("doc_id")).distinct()
        old.join(gone, "doc_id", "left_semi").write.mode("overwrite").parquet(f"{path}/stale/revision={revision}")
    done = spark.range(1).select(F.lit(revision).cast("long").alias("revision"), F.lit(buckets).cast("long").alias("buckets"), F.lit(blocks).cast("long").alias("blocks"))
    done.coalesce(1).write.mode("append").parquet(f"{path}/done")


def live_docs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, len, revision of the documents that no later revision replaces."""
    known = revisions(spark, path)
    docs = spark.read.parquet(f"{path}/docs").where(F.col("revision").isin(known))
    stale = _stale(spark, path, known)
    return docs if stale is None else docs.join(stale, ["doc_id", "revision"], "left_anti")


def _stale(spark: SparkSession, path: str, known: list[int]) -> DataFrame | None:
    stale = _read(spark, path, "stale")
    stale = stale if stale is None else stale.where(F.col("revision").isin(known)).select("doc_id", F.col("stale_in").cast("int").alias("revision"))
    return None if stale is None or stale.isEmpty() else stale


class Index:
    """A reader of an index's complete revisions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        done = spark.read.parquet(f"{path}/done").distinct().collect()  # a row a revision
        self.buckets = {r.revision: r.buckets for r in done}
        self.n_blocks = sum(r.blocks for r in done)
        self.stale = _stale(spark, path, sorted(self.buckets))
        self.docs = live_docs(spark, path)

    def postings(self, asked: DataFrame, n_asked: int, fields: tuple[str, ...] = tuple(POSTING)) -> DataFrame:
        """The rows of the queries' terms: buckets are pruned at the scan, terms where they are read."""
        terms = asked.select("term").distinct()
        wanted = F.lit(False)
        for revision, n in self.buckets.items():
            buckets = [r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(n)).alias("b")).distinct().collect()] if n_asked < 50 * n else None  # n at most
            own = F.col("revision") == revision
            wanted = wanted | (own & (F.col("bucket") != LENGTHS) if buckets is None else own & F.col("bucket").isin(buckets))
        rows = _postings(self.spark, self.path, self.docs.schema["doc_id"].dataType.simpleString(), fields).where(wanted)
        return rows.join(S.few(terms, n_asked), "term", "left_semi").withColumn("block", F.struct("revision", "block"))

    def hits(self, rows: DataFrame) -> DataFrame:
        """Postings of live documents, a row each."""
        flat = rows.select(*(c for c in rows.columns if c not in ("docs", "bucket", "revision")), F.col("revision"), F.explode("docs").alias("d")).select("*", "d.*").drop("d")
        return flat if self.stale is None else flat.join(S.few(self.stale), ["doc_id", "revision"], "left_anti")

    def frequencies(self, rows: DataFrame, count: str, one: Column) -> DataFrame:
        """term and df: from the blocks' counts, or from the postings themselves where some are stale."""
        if self.stale is None:
            df = rows.groupBy("term").agg(F.sum(count).alias("df"))
        else:
            df = self.hits(rows).groupBy("term").agg(F.count_if(one).alias("df"))
        return df.where("df > 0")

    def _met(self, rows: DataFrame, weighted: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
        """rows by the queries that score their block (chosen: query_id and block), dealt by block: a document's scores are summed up there, so that postings are shuffled once and hits are not."""
        each = F.collect_list(F.struct(*(c for c in weighted.columns if c != "term"))).alias("asking")
        chosen = chosen.select("query_id", "block")
        if max(n, chosen.count()) <= S.FEW:
            taken = chosen.groupBy("block").agg(F.collect_list("query_id").alias("taken"))
            met = rows.join(F.broadcast(weighted.groupBy("term").agg(each)), "term").join(F.broadcast(taken), "block")
            met = met.withColumn("asking", F.filter("asking", lambda a: F.array_contains("taken", a["query_id"]))).where(F.size("asking") > 0)
        else:
            met = rows.join(weighted.join(chosen, "query_id").groupBy("term", "block").agg(each), ["term", "block"])
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = met.select("block", "revision", "docs", "asking").repartition(max(least, 4 * self.n_blocks), "block")
        return dealt.select("block", "revision", "docs", F.explode("asking").alias("a")).select("block", "revision", "docs", "a.*")

    def _top(self, weighted: DataFrame, rows: DataFrame, bound: Column, score: Callable[[DataFrame], DataFrame], k: int, n: int, order: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """query_id, doc_id, score of each query's k best: all blocks at once if they are few, else by bounds."""
        if self.n_blocks <= FIRST:
            return order(score(rows.join(S.few(weighted, n), "term")))
        bounds = rows.select("term", "block", "most_tf", "most_weight", "least_len").join(S.few(weighted, n), "term").groupBy("query_id", "block").agg(F.sum(bound).alias("bound"))
        bounds = durable(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))), "bounds")

        def scored(chosen: DataFrame) -> DataFrame:
            return order(score(self._met(rows, weighted, chosen, n)))

        first = durable(scored(bounds.where(F.col("place") <= FIRST)), "first")
        # Of queries with fewer than k documents so far, all blocks are left.
        floor = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
        left = bounds.where(F.col("place") > FIRST).join(floor, "query_id", "left").where(F.coalesce(F.col("bound") + MARGIN >= F.col("floor"), F.lit(True)))
        self.left = left = durable(left, "left")
        return order(first.select("query_id", "doc_id", "score").unionByName(scored(left).select("query_id", "doc_id", "score")))

    def tfidf(self, asked: DataFrame, k: int, *order: Column | str, title: bool = False) -> DataFrame:
        """query_id, doc_id, score (6 decimals), rank: as search.tfidf_scores, of each query's k best by score, then `order`.

        asked: from search.query_tokens.  title: the order needs the documents' titles.
        """
        asked = durable(asked, "asked")
        n, total = asked.count(), self.docs.count()
        rows = self.postings(asked, n, ("tf", "boosted", "indexed"))
        df = self.frequencies(rows, "n_indexed", F.col("indexed"))
        weighted = durable(asked.join(df, "term", "left").withColumn("idf", S.idf(F.lit(total), F.coalesce("df", F.lit(0)))), "weighted")
        bound = 2 * F.greatest(F.col("times") * F.col("most_tf") * F.col("idf"), F.lit(0.0))

        def score(joined: DataFrame) -> DataFrame:
            hits = self.hits(joined)
            some, boost = (F.col("tf") > 0) | F.col("boosted"), F.when(F.col("boosted"), S.TITLE_BOOST).otherwise(0)
            found = hits.groupBy("block", "query_id", "doc_id", "n_terms").agg(
                F.sum(F.when(some, F.col("times") * (F.col("tf") + boost) * F.col("idf")).otherwise(0.0)).alias("raw"), F.sum(F.when(some, F.col("times")).otherwise(0)).alias("matched"), F.max("indexed").alias("candidate")
            )
            return found.where("candidate and raw <> 0").select("query_id", "doc_id", F.round(F.col("raw") * (1 + F.col("matched") / F.col("n_terms")), 6).alias("score"))

        def top(scores: DataFrame) -> DataFrame:
            if title:
                # Only documents that tie with the k-th score or beat it need their titles.
                near = scores.withColumn("__r", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("__r") <= k).drop("__r")
                scores = near.join(self.docs.select("doc_id", "title"), "doc_id")
            return S.top_k(scores, k, F.desc("score"), *order).select("query_id", "doc_id", "score", "rank")

        return self._top(weighted, rows, bound, score, k, n, top)

    def bm25(self, asked: DataFrame, k: int, *order: Column | str) -> DataFrame:
        """query_id, doc_id, bm25 (6 decimals, lower is better), rank of each query's k best.  asked: query_id and term, distinct."""
        asked = durable(asked.select("query_id", "term"), "asked")
        n = asked.count()
        sums = self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("l")).first()
        rows = self.postings(asked, n, ("weight", "len"))
        df = self.frequencies(rows, "n_weighted", F.col("weight") > 0)
        raw = F.log((F.lit(sums.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = durable(asked.join(df, "term").withColumn("idf", F.when(raw <= 0, S.LEAST_IDF).otherwise(raw)), "weighted")
        part = lambda f, size: F.col("idf") * f * (S.K1 + 1) / (f + S.K1 * (1 - S.B + S.B * size / F.lit(sums.l)))
        bound = part(F.col("most_weight"), F.col("least_len"))

        def score(joined: DataFrame) -> DataFrame:
            hits = self.hits(joined).where("weight > 0")
            return hits.groupBy("block", "query_id", "doc_id").agg(F.round(F.sum(part(F.col("weight"), F.col("len"))), 6).alias("score")).drop("block")

        top = lambda scores: S.top_k(scores, k, F.desc("score"), *order)
        return self._top(weighted, rows, bound, score, k, n, top).select("query_id", "doc_id", (-F.col("score")).alias("bm25"), "rank")


def documents_key(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256).alias("h"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)).first()[0]


def opened(docs: DataFrame, root: str, key: str, **columns: str) -> Index:
    """The index of docs below root, named by the key of its contents: built when it is first asked for, and read afterwards."""
    path = f"{root}/index-{key[:32]}"
    append(docs, path, 0, **columns)
    return Index(docs.sparkSession, path)
