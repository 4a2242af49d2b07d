"""N-gram Jaccard join by parity sketches.

A document's set of shingle hashes is dealt, by the hashes' top bits, to m
parts, and each part keeps the XOR (bitwise parity) of its 64-bit hashes.  A
hash in both sets cancels out, and one in the symmetric difference changes one
part, so the number of parts that differ is at most the size of the symmetric
difference.  A Jaccard similarity of s allows a symmetric difference of
(1 - s) / (1 + s) * (|A| + |B|) = d; so of A's parts in any order that all
documents share, one of the first d + 1 is equal in B and among B's first d + 1
(pigeonhole).  m goes by size band.  The order puts parts that many documents
have, as counted over all documents in a table of fixed size, last: passages
that many documents share then make no candidates.

Candidates are rejected by the Hamming distance of whole bit sketches, one bit a
hash, and the rest verified on the texts' shingles, as 64-bit hashes.  A key's
group gives all pairs if small; else pairs with one member, the one that most
groups have.  Where the links found leave a large group in several components,
the members outside its largest one get centres of their own while many are
left, and then their sketches are compared with the other components' members,
block by block: the cost goes with the members that are not yet linked, not with
the square of the group.

No task holds a whole hot group: the counters tell which keys are hot, and the
rows of these are dealt by key and a salt, from the first shuffle on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.llm import common, graph

#: Counters of the parts' order (2 bytes each in every task), by the top bits of a key, in so many chunks.
COUNTER_BITS, CHUNKS = 21, 16
COUNTERS, SHIFT = 1 << COUNTER_BITS, np.uint64(64 - COUNTER_BITS)
#: Parts of the smallest size band, as a power of two.
LEAST_LEVEL = 6
#: Groups up to this size give all pairs.
SMALL = 8
#: Members of a block of a large group; partners that one task verifies against one document.
BLOCK, PARTNERS = 512, 400
#: A key is hot when its counter is so much above twice the mean; rows of a hot key that one task gets.
HOT, SALTED = 2048, 1024
#: Comparisons of sketches up to which open groups are compared at once; beyond, up to so many rounds of new centres come first.
COMPARISONS, CENTRES = 50_000_000, 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def forget() -> None:
    """Empties this worker's memo."""
    _hashes.clear()


def shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text; offsets of the texts).

    A-Z are lower-cased; words lie between ASCII white space; fewer than `size`
    words make one shingle; none make none.
    """
    words = [(t or b"").lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(counts)
    w = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for doc, end, n in zip(words, ends.tolist(), counts.tolist()):
        w[end - n : end] = np.fromiter(map(_hashes.__getitem__, doc), np.uint64, n)
    if not len(w):
        return w, np.zeros(len(texts) + 1, np.int64)
    h = w.copy()
    # A short text's hash takes its own words and, from the length on, marks.
    for k in range(1, size):
        after = np.zeros_like(w)
        after[:-k] = w[k:]
        past = np.zeros(len(w), bool)
        for end in ends[(counts > 0) & (counts < size)].tolist():
            past[max(0, end - k) : end] = True
        after[past] = np.uint64(k)
        h = mix(h * _ODD[0] + after)
    starts = ends - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    h = h[at]
    cut = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(cut.tolist(), cut[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[cut[:-1][n > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[cut]


def levels(n: int, percent: int) -> list[int]:
    """The bands (powers of two of parts) in which a set of n meets its partners: its own, and the next if larger partners reach it."""
    own = max(LEAST_LEVEL, (n - 1).bit_length())
    return [own, own + 1] if n * 100 // percent > 1 << own else [own]


def prefix(n: int, percent: int) -> int:
    """d + 1 for the largest symmetric difference that a set of n can have to a partner."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent) + 1


def part_keys(h: np.ndarray, level: int) -> np.ndarray:
    """Keys of the non-empty parts of a set's sorted hashes."""
    part = h >> np.uint64(64 - level)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return mix(np.bitwise_xor.reduceat(h, first) + mix((part[first] + np.uint64(1)) * _ODD[0] + np.uint64(level)))


def empty_key(level: int) -> int:
    return int(mix(np.array([level], np.uint64) * _ODD[1])[0])


def sketch(h: np.ndarray) -> bytes:
    """Parities of a set's hashes by bit: as many bits as the set's own band has parts."""
    level = max(LEAST_LEVEL, (len(h) - 1).bit_length()) if len(h) else LEAST_LEVEL
    place = mix(h ^ _ODD[1]) & np.uint64((1 << level) - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=1 << level) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A sketch of `size` words from a longer one: places that agree in their low bits add up."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def difference(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """The largest symmetric difference of two sets of these sizes that are similar enough."""
    return (n + m) * (100 - percent) // (100 + percent)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common_ >= percent * (len(a) + len(b) - common_)


def _batch(schema: T.StructType, types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)


def _sets(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """A row a document: id, n, digest of its set; and rows of counters: chunk, counts."""
    out = common.schema_of(common.field(df, id_col), ("n", T.LongType()), ("digest", T.BinaryType()), ("sketch", T.BinaryType()), ("chunk", T.LongType()), ("counts", T.BinaryType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(COUNTERS, np.int64), None
        for whole in batches:
            kind = whole.schema.field(0).type
            for part in common.text_slices(whole, 1):
                h, at = shingles(part.column(1).cast(pa.binary()).to_pylist(), size)
                n, keys, digests, sketches = np.diff(at), [], [], []
                for a, b in zip(at.tolist(), at[1:].tolist()):
                    sketches.append(sketch(h[a:b]))
                    digests.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest())
                    if b > a:
                        keys += [part_keys(h[a:b], level) for level in levels(b - a, percent)]
                if keys:
                    counts += np.bincount((np.concatenate(keys) >> SHIFT).astype(np.int64), minlength=COUNTERS)
                k = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=out.names)
        if kind is not None and counts.any():
            parts = counts.astype(np.uint32).reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, kind), pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, pa.binary()), pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names=out.names)

    return common.spread(df.select(id_col, text_col)).mapInArrow(common.releasing(work, forget), out)


def _order(sets: DataFrame) -> np.ndarray:
    """The counters' totals over all documents, on a scale of 16 bits."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    order = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint16)
    totals = sets.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(common.releasing(add), "chunk long, counts binary")
    for r in totals.toLocalIterator():  # CHUNKS rows, of which the driver holds a few at a time
        order[r.chunk] = np.log2(np.frombuffer(r.counts, np.int64) + 1.0) * 1000
    return order.ravel()


def _keys(df: DataFrame, order: np.ndarray, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """key, id, n, salts: of each document's parts the first by the order; a set that the task has met already is left out.

    salts: over how many tasks a hot key's rows go; 0 for other keys.
    """
    shared = df.sparkSession.sparkContext.broadcast(order)
    out = common.schema_of(("key", T.LongType()), common.field(df, id_col, "id"), ("n", T.LongType()), ("salts", T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        # The counters' scale goes back to counts, the same in every task.
        counts = np.exp2(rank.astype(np.float32) / np.float32(1000))
        over = counts - 2 * counts.mean()
        salts_of = np.where(over > HOT, np.maximum(np.ceil(over / SALTED), 1), 0).astype(np.int32)
        del counts, over
        for whole in batches:
            for part in common.text_slices(whole, 1):
                h, at = shingles(part.column(1).cast(pa.binary()).to_pylist(), size)
                keys, rows, sizes = [], [], []
                for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    n = b - a
                    if not n or (digest := hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(digest)
                    for level in levels(n, percent):
                        own, p = part_keys(h[a:b], level), prefix(n, percent)
                        if len(own) > p:
                            place = (rank[own >> SHIFT].astype(np.uint64) << np.uint64(48)) | (own >> np.uint64(16))
                            own = own[place <= np.partition(place, p - 1)[p - 1]]
                        elif len(own) < p:
                            own = np.append(own, np.uint64(empty_key(level)))
                        keys.append(own)
                        rows.append(i)
                        sizes.append(n)
                if keys:
                    times, together = [len(k) for k in keys], np.concatenate(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(together.view(np.int64)), part.column(0).take(pa.array(np.repeat(rows, times))), pa.array(np.repeat(sizes, times), pa.int64()), pa.array(salts_of[together >> SHIFT])], names=out.names
                    )

    return common.spread(df.select(id_col, text_col).where(F.col(id_col).isNotNull())).mapInArrow(common.releasing(work, forget), out)


def _candidates(keys: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of small groups; and key, a, n, salts: the members of large ones.

    A hot key's rows are dealt over its salts, and are members without being gathered.
    """
    id_type = keys.schema["id"].dataType
    out = common.schema_of(("a", id_type), ("b", id_type), ("key", T.LongType()), ("n", T.LongType()), ("salts", T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        rows: list[tuple] = []
        kind = None
        key, members, large = None, [], False

        def finish() -> None:
            """members come in ascending size."""
            for j, (n, y) in enumerate(members):
                for m, x in members[:j]:
                    if m * 100 >= percent * n and x != y:
                        p = (x, y) if x < y else (y, x)
                        if p not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(p)
                            rows.append((*p, None, None, None))

        for batch in batches:
            kind = batch.schema.field(1).type
            hot = batch.column(3).to_numpy() > 0
            if hot.any():
                h = batch.filter(pa.array(hot))
                yield pa.RecordBatch.from_arrays([h.column(1), pa.nulls(h.num_rows, kind), h.column(0), h.column(2), h.column(3)], names=out.names)
                batch = batch.filter(pa.array(~hot))
            k = batch.column(0).to_numpy()
            if not len(k):
                continue
            # Rows whose neighbours have other keys, and that do not go on from the last batch or into the next, have no partner.
            same = k[1:] == k[:-1]
            lone = ~(np.concatenate([[key is not None and k[0] == key], same]) | np.concatenate([same, [True]]))
            part = batch.take(pa.array(np.flatnonzero(~lone)))
            for now, m_id, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                if now != key:
                    finish()
                    key, members, large = now, [], False
                if large:
                    rows.append((m_id, None, key, n, 1))
                else:
                    members.append((n, m_id))
                    if len(members) > SMALL:
                        rows += [(x, None, key, m, 1) for m, x in members]
                        members, large = [], True
            if len(rows) > 20_000:
                yield _batch(out, [kind, kind, pa.int64(), pa.int64(), pa.int32()], rows)
                rows.clear()
        finish()
        if rows:
            yield _batch(out, [kind, kind, pa.int64(), pa.int64(), pa.int32()], rows)

    dealt = keys.repartition("key", F.when(F.col("salts") > 0, F.pmod(F.xxhash64("id"), F.col("salts"))))
    return dealt.sortWithinPartitions("key", "n", "id").mapInArrow(common.releasing(work), out)


def _with_group(members: DataFrame, groups: DataFrame) -> DataFrame:
    """members (key, salts, a, ...) with their groups' columns; a hot group meets its members salt by salt."""
    each = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")
    return members.withColumn("__salt", F.pmod(F.xxhash64("a"), F.col("salts").cast("long"))).join(each, ["key", "__salt"]).drop("__salt")


def _stars(members: DataFrame, percent: int, centres: DataFrame | None = None) -> DataFrame:
    """a, b: each large group's members with the one of them, or of `centres`, that most large groups have; ties go by a hash."""
    often = members.groupBy("a").agg(F.count(F.lit(1)).alias("groups"))
    chosen = members if centres is None else centres
    centre = chosen.select("key", "salts", "a", "n").join(often, "a").groupBy("key", "salts").agg(F.max_by(F.struct("a", "n"), F.struct("groups", F.hash("a"), "a")).alias("c"))
    pairs = _with_group(members, centre).where((F.col("a") != F.col("c.a")) & (F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent))
    return pairs.select(F.least("a", "c.a").alias("a"), F.greatest("a", "c.a").alias("b")).distinct()


def _near_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches' Hamming distance allows similarity."""
    out = pairs.select("a", "b").schema
    side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, x, m, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_a", "s_a", "n_b", "s_b")))):
                if min(n, m) * 100 >= percent * max(n, m):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    size = min(len(x), len(y))
                    if int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= difference(n, m, percent):
                        keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(common.releasing(work), out).distinct()


def _across(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of a group's members in different components whose sketches are near.

    members: key, a, n, component, giant, size, rest; giant is the component that
    most of a group's `size` members are in, and `rest` the number of the others.
    Each block of the others meets all blocks of the group; two blocks of the
    giant never meet.
    """
    id_type = members.schema["a"].dataType
    out = common.schema_of(("a", id_type), ("b", id_type))
    block = lambda n: F.ceil(n / BLOCK)
    rows = members.join(sketches.select(F.col("id").alias("a"), "sketch"), "a").withColumn("outer", block(F.col("rest"))).withColumn("inner", block(F.col("size") - F.col("rest")))
    linked, place = F.col("component") == F.col("giant"), F.xxhash64("a")
    rows = rows.withColumn("own", F.when(linked, F.col("outer") + F.pmod(place, F.col("inner"))).otherwise(F.pmod(place, F.col("outer"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(linked, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "n", F.xxhash64("component").alias("c"), "sketch")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, seen, kind = None, [], set(), None

        def compare() -> list[tuple]:
            found = []
            if len(held) < 2 or len({r[3] for r in held}) < 2:
                return found
            own, ids, n, c = ([r[k] for r in held] for k in range(4))
            own, n, c = np.array(own), np.array(n), np.array(c)
            bits = [np.frombuffer(r[4], np.uint64) for r in held]
            size = min(map(len, bits))
            table = np.stack([fold(b, size) for b in bits])
            cross = at[1] != at[2]
            for k in range(len(held) - 1):
                rest = slice(k + 1, None)
                ok = (c[rest] != c[k]) & (np.minimum(n[rest], n[k]) * 100 >= percent * np.maximum(n[rest], n[k]))
                if cross:
                    ok &= own[rest] != own[k]
                where = np.flatnonzero(ok) + k + 1
                if len(where):
                    apart = np.bitwise_count(table[where] ^ table[k]).sum(axis=1)
                    for w in where[apart <= difference(n[where], n[k], percent)].tolist():
                        p = (ids[k], ids[w]) if ids[k] < ids[w] else (ids[w], ids[k])
                        if p not in seen:
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(p)
                            found.append(p)
            return found

        found: list[tuple] = []
        for batch in batches:
            kind = batch.schema.field(4).type
            for key, i, j, own, a, n, c, s in zip(*(x.to_pylist() for x in batch.columns)):
                if (key, i, j) != at:
                    found += compare()
                    at, held = (key, i, j), []
                held.append((own, a, n, c, s))
            if len(found) > 20_000:
                yield _batch(out, [kind, kind], found)
                found = []
        found += compare()
        if found:
            yield _batch(out, [kind, kind], found)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(common.releasing(work), out).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs a, b whose texts' sets are similar; a document with many partners is the pair's a, and is dealt to several tasks."""
    out = pairs.select("a", "b").schema
    times = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > PARTNERS)
    times = common.written(times, "busy")
    few = times.count() <= common.BROADCAST_KEYS

    def busy(c: str) -> DataFrame:
        named = times.select(F.col("a").alias(c), F.col("times").alias(f"n_{c}"))
        return F.broadcast(named) if few else named

    swap = F.coalesce("n_b", F.lit(0)) > F.coalesce("n_a", F.lit(0))
    dealt = pairs.join(busy("a"), "a", "left").join(busy("b"), "b", "left").select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.ceil(F.coalesce(F.greatest("n_a", "n_b"), F.lit(1)) / PARTNERS).alias("salts")
    )
    others = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b", "text")
    own = dealt.select("a", "salts").distinct().select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    own = own.join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast(out["b"].dataType).alias("b"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for whole in batches:
            for part in common.text_slices(whole, 3):
                h, cut = shingles(part.column(3).cast(pa.binary()).to_pylist(), size)
                keep = []
                for i, (a, salt, b) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist())):
                    own = h[cut[i] : cut[i + 1]]
                    if (a, salt) != at:
                        at, held = (a, salt), []
                    if b is None:
                        held.append(own.copy())
                    elif any(jaccard_at_least(x, own, percent) for x in held):
                        keep.append(i)
                if keep:
                    found = part.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], names=["a", "b"])

    both = own.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return both.mapInArrow(common.releasing(work, forget), out).distinct()


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles (size of the set) and component_id (smallest id reachable by links, itself included) of every row.

    Sets are distinct `size`-word shingles; two rows link when their Jaccard
    similarity is percent / 100 or more.  Null, empty and blank texts have no
    shingles and link with nothing; rows with equal sets always link.  Rows that
    repeat an id are one node.  Null ids are in no component (null).  An empty
    table gives no rows; other columns are ignored.  Shingles are compared by
    64-bit hashes, sets by 128-bit digests.
    """
    common.small_batches(df.sparkSession)
    sets = common.written(_sets(df, id_col, text_col, size, percent), "sets")
    rows = sets.where("chunk is null").select(F.col(id_col).alias("id"), "n", "digest", "sketch")
    full = rows.where("n > 0 and id is not null")
    groups = common.written(full.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")), "groups")
    # Members of large groups of equal sets, of which there are few, by broadcast; the rest by a shuffle.
    total = groups.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    floor = max(2, -(-total // 1000))
    heavy = groups.where(F.col("times") >= floor).select("digest", F.col("rep").alias("heavy"))
    marked = full.join(F.broadcast(heavy), "digest", "left")
    same = marked.where("heavy is not null").select("id", F.col("heavy").alias("rep")).unionByName(marked.where("heavy is null").join(groups.where(F.col("times").between(2, floor - 1)), "digest").select("id", "rep"))
    same = common.written(same.where("id <> rep").distinct(), "same")

    found = common.written(_candidates(_keys(df, _order(sets), id_col, text_col, size, percent), percent), "candidates")

    def to_reps(table: DataFrame, column: str) -> DataFrame:
        named = same.select(F.col("id").alias(column), F.col("rep").alias("__rep"))
        return table.join(named, column, "left").withColumn(column, F.coalesce("__rep", column)).drop("__rep")

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    sketches = full.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "sketch")
    members = common.written(to_reps(found.where("key is not null").select("key", "salts", "a", "n"), "a").distinct(), "members")
    pairs = apart(to_reps(to_reps(found.where("b is not null").select("a", "b").distinct(), "a"), "b")).unionByName(_stars(members, percent)).distinct()
    near = common.written(_near_sketches(pairs, sketches, percent), "near")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        texts = common.matched(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids, "id", "left_semi")
        return _verified(pairs, common.written(texts, "texts"), size, percent)

    # An id that stands for several sets makes them one node.
    several = full.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    several = apart(full.join(several, "id", "left_semi").join(groups, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    links = common.written(verified(near).unionByName(several).distinct(), "links")
    named = _components(links, same)
    for centres_left in range(CENTRES, -1, -1):
        rest = common.written(_open(members, named), "open")
        compared = rest.where("component <> giant").agg(F.sum(F.col("size").cast("double"))).first()[0]
        if compared is None:
            break
        if centres_left and compared > COMPARISONS:
            more = _near_sketches(_stars(rest, percent, rest.where("component <> giant")), sketches, percent)
        else:
            more = _across(rest, sketches, percent)
        more = common.written(more.join(near, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            near = near.unionByName(more)
            links = common.written(links.unionByName(verified(more)), "links")
            named = _components(links, same)
        if not centres_left or compared <= COMPARISONS:
            break
    common.give_back()
    component = F.coalesce("component", "id")
    return rows.join(named.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _open(members: DataFrame, named: DataFrame) -> DataFrame:
    """members of the groups that lie in several components: key, salts, a, n, component, giant (the largest one), size, rest (members outside the giant)."""
    placed = members.join(named.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    parts = placed.groupBy("key", "salts", "component").agg(F.count(F.lit(1)).alias("c"))
    groups = parts.groupBy("key", "salts").agg(F.max_by("component", F.struct("c", "component")).alias("giant"), F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("rest"))
    return _with_group(placed, groups.where("rest > 0"))


def _components(links: DataFrame, same: DataFrame) -> DataFrame:
    """node and component of linked representatives and of all that share a set with one."""
    named = graph.components(links)
    reps = same.select("rep").distinct().join(named.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.select("rep", F.coalesce("component", "rep").alias("component"))
    others = same.select("id", F.col("rep")).join(reps, "rep").select(F.col("id").alias("node"), "component")
    return common.written(named.unionByName(others).groupBy("node").agg(F.min("component").alias("component")), "named")
