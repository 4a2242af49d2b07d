"""How far the sources of a language diverge in their terms, exactly, by a heavy-light split.

A group is a language and source; its smoothed share of a term is
p = 1 + floor(scale * (count + add) / (N + add * V)), in integers.  Two groups
diverge by the sum of |p - q| over all V kept terms of their language.

Terms that many of a language's groups have are heavy: blocks of them are dense
numpy tiles, of at most TILE groups a side, whose differences are summed at once.
All other terms are light.  Were no group to have any of them, their sum would be
V_light * |z - y|, with z and y the two groups' shares of a count of 0.  Each group
then adds what its own light terms change against the other's y: a sum over its
counts, told for all y by one sorted pass.  Where both groups have a term, that
counts it once for each; the postings' pairs correct it.  The partial sums are
integers and are added up by pair, so the result does not depend on the split.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessella.llm import common

#: Documents of a language that have a term at least; smoothing; scale of the shares; terms that a group reports.
LEAST, ADD, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Groups of a side of a tile, and terms of a block; postings that one task corrects at a time, and pairs at once.
TILE, BLOCK, BUCKET, PAIRS = 256, 2048, 200_000, 1 << 21
#: Terms that a task counts before it hands them on; bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 22
#: A term of k postings costs k^2 pairs, some eight times the work of a dense cell: heavy from 8 k^2 >= groups^2.
DENSE = 8
#: Rows that are broadcast at most, and bytes of their strings.
FEW_ROWS, FEW_BYTES = 100_000, 8 << 20

# A-Z are lower-cased, all other ASCII but a-z separates terms, and all else stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a piece at a time."""
    flat, a = text.translate(_TABLE), 0
    while a < len(flat):
        b = len(flat) if len(flat) - a <= PIECE else flat.find(b" ", a + PIECE)
        b = len(flat) if b < 0 else b
        yield flat[a:b].split()
        a = b


def term_counts(df: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """by, term, n (occurrences) and docs (rows with it): partial counts of each task; and a row of term null for every group that a task meets.

    Nulls of by and text count as ''.
    """
    out = common.schema_of(*((c, T.StringType()) for c in by), ("term", T.StringType()), ("n", T.LongType()), ("docs", T.LongType()))

    def flush(held: dict[tuple, dict[bytes, list[int]]]) -> Iterator[pa.RecordBatch]:
        for group, counted in held.items():
            n = len(counted) + 1
            columns = [pa.array([g], pa.string()).take(pa.array(np.zeros(n, np.int64))) for g in group]
            pairs = list(counted.values())
            made = [pa.array([*counted, None], pa.binary()).cast(pa.string()), pa.array([p[0] for p in pairs] + [0], pa.int64()), pa.array([p[1] for p in pairs] + [0], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=out.names)
        held.clear()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0
        for whole in batches:
            for part in common.text_slices(whole, 0):
                groups = zip(*(part.column(1 + i).to_pylist() for i in range(len(by))))
                for text, group in zip(part.column(0).cast(pa.binary()).to_pylist(), groups):
                    counted = held.setdefault(group, {})
                    own: Counter = Counter()
                    for piece in terms(text):
                        own.update(piece)
                    for term, n in own.items():
                        if pair := counted.get(term):
                            pair[0] += n
                            pair[1] += 1
                        else:
                            counted[term] = [n, 1]
                            size += 1
                    size += 1
                    if size > HELD:
                        yield from flush(held)
                        size = 0
        yield from flush(held)

    rows = df.select(common.text_or_empty(text_col).alias("__text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by))
    return common.spread(rows).mapInArrow(common.releasing(work), out)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * kept)), in decimals of enough digits; 1 + SCALE * (count + ADD) where nothing is kept."""
    whole = F.greatest(total + F.lit(ADD) * kept, F.lit(1)).cast("decimal(19,0)")
    parts = (count + F.lit(ADD)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", parts, whole) + F.lit(1).cast("long")


def few(df: DataFrame, *text: str) -> DataFrame:
    """df, broadcast if its rows and the bytes of its strings are counted to be few."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.octet_length(c) for c in text), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= FEW_ROWS and size <= FEW_BYTES else df


def heavy(groups: Column, all_groups: Column) -> Column:
    return DENSE * groups * groups >= all_groups * all_groups


def _codes(terms: pa.ChunkedArray) -> np.ndarray:
    """A number a distinct term; -1 for null."""
    return terms.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _dense(block: pa.Table) -> pa.Table:
    """Sums of |p - q| of one block of terms and one tile of groups by another, or by itself; rows without a term have the shares of a count of 0, and how many terms the block has, in these groups or others."""
    side, group, p = (block[c].to_numpy() for c in ("side", "group", "p"))
    code = _codes(block["term"])
    zero = code < 0
    code = code[~zero]
    absent = block["terms"].drop_null()[0].as_py() - (int(code.max()) + 1 if len(code) else 0)
    tiles = []
    for s in (0, 1):
        own = zero & (side == s)
        groups, first = np.unique(group[own], return_index=True)
        tile = np.repeat(p[own][first][None, :], code.max() + 1 if len(code) else 0, axis=0)
        mine = side[~zero] == s
        tile[code[mine], np.searchsorted(groups, group[~zero][mine])] = p[~zero][mine]
        tiles.append((groups, np.ascontiguousarray(tile), p[own][first]))
    (rows, a, z), (columns, b, y) = tiles if len(tiles[1][0]) else (tiles[0], tiles[0])
    lo, hi, value = [], [], []
    for i, g in enumerate(rows.tolist()):
        later = columns > g
        if later.any():
            lo.append(np.full(int(later.sum()), g))
            hi.append(columns[later])
            value.append(np.abs(b[:, later] - a[:, i : i + 1]).sum(axis=0, dtype=np.int64) + absent * np.abs(y[later] - z[i]))
    return _sums(block["lang"][0].as_py(), lo, hi, value)


def _sums(lang: str, lo: list, hi: list, value: list) -> pa.Table:
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lo, hi, value)]
    return pa.table({"lang": pa.array([lang] * len(flat[0]), pa.string()), "lo": pa.array(flat[0], pa.int64()), "hi": pa.array(flat[1], pa.int64()), "value": pa.array(flat[2], pa.int64())})


def _corrections(bucket: pa.Table) -> pa.Table:
    """Of light terms, sums of |p - q| - |p - y| - |z - q| + |z - y| over the terms that both groups have: what counting each group's terms alone gets wrong."""
    term = _codes(bucket["term"])
    group, p, z = (bucket[c].to_numpy() for c in ("group", "p", "z"))
    order = np.lexsort((group, term))
    term, group, p, z = term[order], group[order], p[order], z[order]
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(term)]]))
    # Each posting meets the later ones of its term.
    later = np.repeat(starts + sizes, sizes) - np.arange(len(term)) - 1
    total: dict[tuple[int, int], int] = {}
    cuts = np.searchsorted(np.cumsum(later), np.arange(PAIRS, int(later.sum()) + PAIRS, PAIRS), side="left") + 1
    a = 0
    for b in np.minimum(cuts, len(term)).tolist():
        if b <= a:
            continue
        n = later[a:b]
        x = np.repeat(np.arange(a, b), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        change = np.abs(p[x] - p[y]) - np.abs(p[x] - z[y]) - np.abs(z[x] - p[y]) + np.abs(z[x] - z[y])
        pairs, at = np.unique(np.stack([group[x], group[y]], axis=1), axis=0, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, at.ravel(), change)
        for (g, h), s in zip(pairs.tolist(), sums.tolist()):
            total[g, h] = total.get((g, h), 0) + s
        a = b
    keys = np.array(list(total), np.int64).reshape(-1, 2)
    return _sums(bucket["lang"][0].as_py(), [keys[:, 0]], [keys[:, 1]], [np.array(list(total.values()), np.int64)])


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a group (lang, group, z, light, ps, times, groups, zs): what its own light terms make of the sum with each other group, and, once a pair, light * |z - y|."""
    for batch in batches:
        for lang, g, z, light, ps, times, groups, zs in zip(*(batch.column(i) for i in range(8))):
            g, z = g.as_py(), z.as_py()
            p, m = (np.array(x.as_py(), np.int64) for x in (ps, times))
            order = np.argsort(p)
            p, m = p[order], m[order]
            h, y = (np.array(x.as_py(), np.int64) for x in (groups, zs))
            # Sum of m * |p - y| from the sums of what is below y and above it.
            at = np.searchsorted(p, y)
            below, weight = np.concatenate([[0], np.cumsum(m * p)]), np.concatenate([[0], np.cumsum(m)])
            value = y * (2 * weight[at] - weight[-1]) + below[-1] - 2 * below[at] - weight[-1] * np.abs(z - y)
            value += np.where(h > g, light.as_py() * np.abs(z - y), 0)
            other = h != g
            k = int(other.sum())
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * k, pa.string()), pa.array(np.minimum(h, g)[other]), pa.array(np.maximum(h, g)[other]), pa.array(value[other])], names=["lang", "lo", "hi", "value"])


def audit(df: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others (part pair), and the terms that it has most above the language (part term).

    A language keeps the terms that LEAST of its rows have.  Every (lang, source)
    that occurs is a group, with terms or not; null text, lang and source count as
    ''.  pair: value is the sum of |p - q| over all kept terms (0 if none is kept)
    for each other source of the language; all ranks.  term: of the kept terms
    that occur in the group with p above the language's q, the TOP largest p - q.
    Ranks go by value descending, then item in UTF-8 order, so ties have one order.
    Rows are counted one by one, whatever their ids; other columns are ignored; an
    empty table gives no rows.  Texts are split 4 MB at a time.
    """
    common.small_batches(df.sparkSession)
    counted = term_counts(df.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), ["lang", "source"], "text")
    # One shuffle by language and term adds up the groups' counts and gathers a term's groups, of which a term has one a source at most.
    groups = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    gathered = groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("groups"))
    kept = common.written(gathered.where((F.col("docs") >= LEAST) | F.col("term").isNull()), "kept")

    sources = kept.where("term is null").select("lang", F.size("groups").cast("long").alias("n_groups"), "groups.source")
    per_lang = few(sources.select("lang", "n_groups"), "lang")
    sized = kept.where("term is not null").join(per_lang, "lang").withColumn("k", F.size("groups").cast("long")).withColumn("heavy", heavy(F.col("k"), F.col("n_groups")))
    # Sums of languages: kept terms, occurrences, light terms and their postings, heavy terms.
    langs = sized.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"), F.count_if(~F.col("heavy")).alias("light"), F.sum(F.when(~F.col("heavy"), F.col("k")).otherwise(0)).alias("postings")
    )
    totals = sized.select("lang", F.explode("groups").alias("g")).groupBy("lang", "g.source").agg(F.sum("g.n").alias("total"))
    named = sources.select("lang", "n_groups", F.explode("source").alias("source")).join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total", "light", "postings"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    zero = share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    named = common.written(named.withColumn("group", number).withColumn("z", zero), "groups")

    each = sized.select("lang", "term", "heavy", F.col("n").alias("lang_n"), F.posexplode("groups").alias("place", "g")).select("lang", "term", "heavy", "lang_n", (F.col("place") == 0).alias("first"), "g.source", "g.n")
    shares = each.join(few(named, "lang", "source"), ["lang", "source"]).select(
        "lang", "source", "group", "term", "heavy", "first", "z", "kept", "light", "postings", "n_groups", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
    )
    shares = common.written(shares, "shares")

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    pairs = _pairs(shares, named)
    ends = few(named.select("lang", "group", "source"), "lang", "source")
    both = pairs.join(ends.select("lang", F.col("group").alias("lo"), F.col("source").alias("a")), ["lang", "lo"]).join(ends.select("lang", F.col("group").alias("hi"), F.col("source").alias("b")), ["lang", "hi"])
    turned = both.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"))
    ranked = turned.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(top)


def _pairs(shares: DataFrame, named: DataFrame) -> DataFrame:
    """lang, lo, hi, value of every pair of a language's groups: the partial sums of dense tiles, of light terms alone and of their corrections."""
    schema = "lang string, lo long, hi long, value long"
    several = shares.where("n_groups > 1")
    # Dense: a block of terms meets each pair of tiles that has one of its groups in it.
    blocks = F.greatest(F.ceil((F.col("kept") - F.col("light")) / BLOCK), F.lit(1))
    tile = F.floor(F.col("group") / TILE)
    last = F.floor((F.col("n_groups") - 1) / TILE)
    rows = several.where("heavy").select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "term", "group", "p", "first", tile.alias("tile"), last.alias("last"))
    size = rows.groupBy("lang", "block").agg(F.count_if("first").alias("terms"))
    none = named.where("n_groups > 1 and kept > light").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(None).cast("string").alias("term"), "group", F.col("z").alias("p"), tile.alias("tile"), last.alias("last"))
    none = none.join(size, ["lang", "block"])
    met = rows.drop("first").withColumn("terms", F.lit(None).cast("long")).unionByName(none).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = met.select("lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "term", "group", "p", "terms")
    dense = met.groupBy("lang", "block", "i", "j").applyInArrow(_dense, schema)
    # Light: buckets of whole terms.
    light = several.where("not heavy")
    buckets = F.greatest(F.ceil(F.col("postings") / BUCKET), F.lit(1))
    sparse = light.select("lang", F.pmod(F.xxhash64("term"), buckets).alias("bucket"), "term", "group", "p", "z").groupBy("lang", "bucket").applyInArrow(_corrections, schema)
    # A group's light terms by their shares, of which there are few, beside all groups' shares of a count of 0.
    by_share = light.groupBy("lang", "group", "p").agg(F.count(F.lit(1)).alias("times")).groupBy("lang", "group").agg(F.collect_list("p").alias("ps"), F.collect_list("times").alias("times"))
    all_ = named.groupBy("lang").agg(F.collect_list(F.struct("group", "z")).alias("all"))
    nothing = F.array().cast("array<bigint>")
    alone = named.where("n_groups > 1").select("lang", "group", "z", "light").join(by_share, ["lang", "group"], "left").join(all_, "lang")
    alone = alone.select("lang", "group", "z", "light", F.coalesce("ps", nothing).alias("ps"), F.coalesce("times", nothing).alias("times"), F.col("all.group").alias("groups"), F.col("all.z").alias("zs")).mapInArrow(_alone, schema)
    summed = dense.unionByName(sparse).unionByName(alone).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    return summed
