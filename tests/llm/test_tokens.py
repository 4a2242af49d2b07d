"""Packing, token files and token counts against the tokenizers library on whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tessella.llm import bitplanes, catalog, counting, packing, tokenizing

TRICKY = [
    None, "", " ", "a", "Don't stop it's we'll O'Neil 'S '' 't", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "ΑΣ ΣΑΣ οδός ΌΣΟΣ", "İstanbul ı ſ ß ẞ ŉ",
    "é é Å ẛ̣", "12³ ½ ٣ Ⅷ 1234", "日本語のテキスト、です。", "emoji 👩‍👩‍👧 ☃️!!", "tab\tnbsp thin line nel\x85fs\x1cend", "__init__ a_b *** --- ...'s", "\x00null\x07", "x" * 5000,
    "¡Qué! «guillemets» “quotes” — dash… €5", "<|", "<|endoftext|", "a" * 30 + " " + "é" * 3000,
]


@pytest.fixture(scope="module")
def rows(spark):
    texts = TRICKY + TRICKY[4:8]
    return spark.createDataFrame([(i if i != 3 else 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, n long")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(catalog.tokenizer_path(catalog.WORDS))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("segment", [3, 1 << 16])
def test_encoder_is_the_library(library, spark, sf_dir, monkeypatch, segment):
    monkeypatch.setattr(tokenizing, "SEGMENT", segment)
    enc = tokenizing.Encoder(catalog.tokenizer_path(catalog.WORDS), memo=50)
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in texts:
        ids = library(text)
        assert np.frombuffer(enc.encode(text or ""), "<u4").tolist() == ids
        pieces, other = enc.pieces(text or "")
        assert other + sum(map(enc.count, pieces)) == len(ids)


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", True), ("piece_bpe_32k.model", False)])
def test_other_files(name, cut):
    enc = tokenizing.Encoder(catalog.tokenizer_path(name))
    for text in [t for t in TRICKY if t] + ["Hello there, it's 12 o'clock  x\n\n y"]:
        pieces, other = enc.pieces(text)
        pieces = list(pieces)
        assert bool(pieces) == cut and other + sum(map(enc.count, pieces)) == len(enc.library(text)) == len(enc.encode(text)) // 4


def test_counts_of_another_file(spark, rows):
    from tokenizers import Tokenizer

    path = catalog.tokenizer_path(catalog.BYTES)
    tok = Tokenizer.from_file(path)
    got = counting.count_tokens(rows.drop("n"), path, frequent=3).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in rows.collect()]
    assert sorted(map(tuple, got)) == sorted((*w, w[2] > 2048) for w in want)
    assert counting.piece_table(rows, path).where("octet_length(piece) > 64").count() > 0


def expected(library, rows):
    return [(r.doc_id, r.text, [*library(r.text), 1]) for r in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_packing(docs, pieces, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
        assert p.length > 0
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, ids in docs.items():
        at = 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and bytes(p.ids) == np.asarray(ids[at : at + p.length], "<u4").tobytes()
            at += p.length
        assert at == len(ids)
    assert not by_doc
    return by_seq


def test_packing_round_trip(spark, sf_dir, library):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: ids for r, ids in ((r, [*library(r.text), 1]) for r in df.collect())}
    pieces = packing.pack_documents(df, catalog.tokenizer_path(catalog.WORDS)).collect()
    by_seq = check_packing(docs, pieces, 2048)
    total = sum(map(len, docs.values()))
    assert 1 - total / (2048 * len(by_seq)) < 0.03


def test_packing_query(spark, library):
    """op4's columns against the library's ids, and its padding over the documents of sf0.01."""
    base = "/root/testdata/sf0.01"
    docs = {r.doc_id: [*library(r.text), 1] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    spans, fill = defaultdict(list), defaultdict(list)
    for r in catalog.op4_packing(spark, base).collect():
        spans[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        fill[r.sequence_id].append((r.offset, r.length))
    assert sorted(spans) == sorted(docs)
    for doc_id, parts in spans.items():
        at, ids = 0, docs[doc_id]
        for start, length, check, n in sorted(parts):
            assert (start, n) == (at, len(ids)) and check == crc(ids[at : at + length])
            at += length
        assert at == len(ids)
    for parts in fill.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048
    assert 1 - sum(map(len, docs.values())) / (2048 * len(fill)) < 0.02


def test_packing_odd_rows(spark, rows, library):
    odd = rows.where("doc_id <> 2")
    docs = {r.doc_id: [*library(r.text), 1] for r in odd.collect()}
    check_packing(docs, packing.pack_documents(odd, catalog.tokenizer_path(catalog.WORDS), capacity=64, most=32).collect(), 64)
    assert packing.pack_documents(rows.limit(0), catalog.tokenizer_path(catalog.WORDS)).collect() == []


def test_differencing_levels_windows():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 300, 400)
    window = packing.differencing(sizes, 16)
    fills = np.bincount(window, sizes, 16)
    assert fills.sum() == sizes.sum() and fills.max() - fills.min() <= 3
    window, k = packing.windows(np.array([60, 60, 60]), 100, 0.0)
    assert k == 3 and np.bincount(window, [60, 60, 60], k).max() == 60
    assert packing.windows(np.array([], np.int64), 100, 0.0)[0].tolist() == []


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0], np.uint32), np.array([2**32 - 1, 0, 7], np.uint32), rng.integers(0, 49408, 1000).astype(np.uint32)):
        assert bitplanes.from_planes(bitplanes.to_planes(ids, mode), len(ids), mode).tolist() == ids.tolist()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_token_files_round_trip(spark, rows, library, mode):
    manifest = bitplanes.write_token_files(rows, catalog.tokenizer_path(catalog.WORDS), mode=mode, block=100)
    back = bitplanes.read_token_files(spark, manifest, T.LongType()).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in back) == sorted((i, len(x), np.asarray(x, "<u4").tobytes()) for i, _, x in expected(library, rows.collect()))
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(back, key=lambda r: r.start)] == sorted(r.doc_id for r in back)
    assert bitplanes.read_token_files(spark, bitplanes.write_token_files(rows.limit(0), catalog.tokenizer_path(catalog.WORDS))).collect() == []


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,2)", "date"])
def test_ids_of_other_types(spark, kind):
    from pyspark.sql import functions as F

    day = F.col("id") if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(12).select(day.cast(kind).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    back = bitplanes.read_token_files(spark, bitplanes.write_token_files(df, catalog.tokenizer_path(catalog.WORDS)))
    assert dict(back.dtypes)["doc_id"] == kind
    assert [r.doc_id for r in back.orderBy("start").collect()] == [r.doc_id for r in df.orderBy("doc_id").collect()]
    with pytest.raises(ValueError):
        bitplanes.write_token_files(df.withColumn("doc_id", F.lit(b"x")), catalog.tokenizer_path(catalog.WORDS))


def test_a_task_that_runs_again_publishes_once(tmp_path):
    """A lost executor's task leaves a draft or a complete file; the next attempt's file has the same bytes."""
    from pyarrow import fs

    store = fs.LocalFileSystem()
    for attempt in (0, 1):
        (tmp_path / f".part.{attempt}").write_bytes(b"same")
        bitplanes.publish(store, str(tmp_path / f".part.{attempt}"), str(tmp_path / "part"))
    (tmp_path / ".part.2").write_bytes(b"half")
    assert (tmp_path / "part").read_bytes() == b"same" and sorted(p.name for p in tmp_path.iterdir()) == [".part.2", "part"]


def test_lost_tasks_write_the_same_files(spark, rows, tmp_path, monkeypatch):
    """Writing again to a folder that has the files already, as after a lost stage, changes nothing and reads back the same."""
    first = bitplanes.write_token_files(rows, catalog.tokenizer_path(catalog.WORDS), str(tmp_path))
    files = {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    second = bitplanes.write_token_files(rows, catalog.tokenizer_path(catalog.WORDS), str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == files
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_read_back_takes_a_task_a_file(spark, rows):
    from pyspark.sql import functions as F

    manifest = bitplanes.write_token_files(rows, catalog.tokenizer_path(catalog.WORDS))
    twice = manifest.unionByName(manifest.withColumn("part", F.col("part") + 1000))
    back = bitplanes.read_token_files(spark, twice)
    assert back.rdd.getNumPartitions() == twice.count() > 1 and back.count() == 2 * rows.count()
    assert back.agg(F.max("start") + F.max_by("n_tokens", "start")).first()[0] == twice.agg(F.sum("n_ids")).first()[0]


def test_token_file_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in catalog.op8_token_files(spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library(r.text), 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


@pytest.mark.parametrize("frequent", [0, 5, 200_000])
def test_counts(spark, rows, library, frequent):
    got = counting.count_tokens(rows.drop("n"), catalog.tokenizer_path(catalog.WORDS), limit=10, frequent=frequent).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library(r.text))) for r in rows.collect()]
    assert sorted(map(tuple, got)) == sorted((*w, w[2] > 10) for w in want)
    assert counting.count_tokens(rows.limit(0), catalog.tokenizer_path(catalog.WORDS)).collect() == []


def test_count_query(spark, sf_dir, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in catalog.op10_token_counts(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(library(r.text))
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 2048)


def test_a_group_of_one_token_documents_is_bounded():
    """Half a million pieces of one id: few items to difference, and full windows."""
    group = packing._Group(2048, 1024, 8, 0.003)
    for i in range(524_288):
        group.add(i, 0, b"\1\0\0\0", 1)
    items = len(group.items)
    placed, k = group.flush()
    fill = np.zeros(k, np.int64)
    seen = np.zeros(524_288, bool)
    for doc, _, ids, _, w, offset in placed:
        assert offset == fill[w] and not seen[doc]
        fill[w] += len(ids) // 4
        seen[doc] = True
    assert seen.all() and fill.max() <= 2048 and 1 - fill.sum() / (2048 * k) < 0.02
    # Two numbers a window for every item, eight bytes each.
    assert items * k * 16 < 80 << 20


def test_packing_a_partition_of_empty_texts(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text")).coalesce(1)
    out = packing.pack_documents(df, catalog.tokenizer_path(catalog.WORDS))
    r = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).agg(F.sum("n").alias("n"), F.max("end").alias("most"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") != F.col("end")).alias("gaps")).first()
    assert r.n == 60_000 and r.most <= 2048 and r.gaps == 0 and 1 - r.n / (2048 * r.k) < 0.04
