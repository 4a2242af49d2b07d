"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessella.llm import common

#: Hash buckets, and the lengths of n-grams in characters.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: The classifier's probabilities are fitted on so many documents a language at most, by expectation; languages of one matrix, beyond which there are several.
SAMPLE, LANGUAGES = 3000, 256
#: What a text without a letter gets.
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: N-grams x languages scored at a time.
CELLS = 4 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def grams(text: str) -> np.ndarray:
    """Buckets of all the lower-cased text's n-grams; a space stands at either end, each run of white space is one."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - (BUCKETS - 1).bit_length())
    found = []
    for order in ORDERS:
        n = len(points) - order + 1
        if n > 0:
            h = np.full(n, order, np.uint32)
            for i in range(order):
                h = (h ^ points[i : i + n]) * _MULTIPLIERS[i]
                h ^= h >> np.uint32(15)
            found.append((h * _MULTIPLIERS[-1]) >> shift)
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """languages in ascending order; log_prior by language; log_prob: bucket x language, 256 KB a language."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its posterior probability) of each text; equal probabilities go to the first language."""
        return [(UNDETERMINED, 0.0) if x is None else (x[0], 1.0 / x[2]) for x in self.joint(texts)]

    def joint(self, texts: list[str]) -> list[tuple[str, float, float] | None]:
        """(best language, its joint log-probability, the sum of all languages' probabilities by its own) of each text with a letter."""
        out: list[tuple[str, float, float] | None] = [None] * len(texts)
        if not self.languages:
            return out
        rows = [i for i, t in enumerate(texts) if LETTER.search(t)]
        k = len(self.languages)
        while rows:
            held, sizes = [], []
            while rows and sum(sizes) * k < CELLS:
                h = grams(texts[rows[len(sizes)]]) if len(sizes) < len(rows) else None
                if h is None:
                    break
                held.append(h)
                sizes.append(len(h))
            now, rows = rows[: len(sizes)], rows[len(sizes) :]
            for i, s in zip(now, self._totals(held, sizes)):
                best = int(s.argmax())
                out[i] = (self.languages[best], float(s[best]), float(np.exp(s - s[best]).sum()))
        return out

    def parts(self, most: int) -> list[Model]:
        """The model of each `most` languages."""
        cuts = range(0, max(1, len(self.languages)), most)
        return [Model(self.languages[a : a + most], self.log_prior[a : a + most], np.ascontiguousarray(self.log_prob[:, a : a + most])) for a in cuts]

    def _totals(self, held: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """Log-probabilities by text and language, a bounded number of cells at a time."""
        step = max(1, CELLS // len(self.languages))
        if len(held) == 1:
            h = held[0]
            return (self.log_prior + sum(self.log_prob[h[a : a + step]].sum(axis=0, dtype=np.float64) for a in range(0, len(h), step)))[None]
        cells = self.log_prob[np.concatenate(held)]
        return self.log_prior + np.add.reduceat(cells, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.float64)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Learns from rows with a language and a text.

    A language's prior is its share of all rows with a language.  Its n-grams'
    probabilities come from a sample: of a language with more than `sample` rows,
    those whose id's hash is low enough, whole.  Every language with a text in
    the sample is learned; the driver holds 768 KB for each.
    """
    common.small_batches(df.sparkSession)
    df = df.where(F.col(lang_col).isNotNull())
    counted = df.groupBy(F.col(lang_col).alias("__lang")).count()
    sizes = {r[0]: r["count"] for r in counted.collect()}  # a row a language
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = counted.select("__lang", F.least(F.lit(1.0), sample / F.col("count")).alias("__share"))
    drawn = df.join(F.broadcast(share), F.col(lang_col) == F.col("__lang")).where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.col("__share") * (1 << 30))
    taken = drawn.where(F.col(text_col).isNotNull()).select(lang_col, text_col)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang in counts:
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([counts[lang].tobytes()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    # The sample is bounded, so a few tasks count it; each gives a row a language.
    for r in taken.repartition(max(4, len(sizes) // 4)).mapInArrow(common.releasing(tally), "lang string, counts binary").toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.counts, np.int64)
    names = sorted(total)
    if not names:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([total[x] for x in names], axis=1) + smoothing
    prior = np.array([sizes[x] for x in names], np.float64)
    return Model(names, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def identify(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, languages: int = LANGUAGES) -> DataFrame:
    """lang_pred and score (0 to 1) of every row's whole text, after the columns in keep (the id).

    Null texts, texts without a letter and all texts under a model that has
    learned nothing get `und` and 0.  Ties go to the first language in order;
    repeated rows are rows; an empty table gives none; columns called lang_pred
    or score in keep are an error, all others are carried on.

    Workers get the matrix of `languages` languages at a time (64 MB for 256);
    more take a pass over the texts each, with a written table between.
    """
    keep = keep or [id_col]
    if taken := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"identify() makes columns of the names {sorted(taken)}")
    common.small_batches(df.sparkSession)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("log", T.DoubleType()), T.StructField("mass", T.DoubleType())])

    def scorer(part: Model):
        shared = df.sparkSession.sparkContext.broadcast(part)

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for whole in batches:
                found: list = []
                for texts in common.text_slices(pa.RecordBatch.from_arrays([whole], names=["text"]), 0):
                    found += shared.value.joint([t or "" for t in texts.column(0).to_pylist()])
                columns = zip(*(x or (None, None, None) for x in found)) if found else [[]] * 3
                yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))], names=["lang", "log", "mass"])

        @F.arrow_udf(kind)
        def joint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from common.releasing(score)(batches)

        # A filter on the prediction is not pushed below it, where it would score every text again.
        return joint.asNondeterministic()

    columns = [c for c in df.columns if c in {*keep, text_col}]
    parts = model.parts(languages)
    rows = common.spread(df.select(columns)).withColumn("__p", scorer(parts[0])(text_col))
    for part in parts[1:]:
        rows = common.written(rows, "languages").withColumn("__q", scorer(part)(text_col))
        # The better of both, the first of equals, and both sums on its scale.
        p, q = F.col("__p"), F.col("__q")
        better = F.when(q["log"] > p["log"], F.struct(q["lang"].alias("lang"), q["log"].alias("log"), (q["mass"] + p["mass"] * F.exp(p["log"] - q["log"])).alias("mass")))
        rows = rows.withColumn("__p", better.otherwise(F.struct(p["lang"].alias("lang"), p["log"].alias("log"), (p["mass"] + q["mass"] * F.exp(q["log"] - p["log"])).alias("mass")))).drop("__q")
    return rows.select(*keep, F.coalesce("__p.lang", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(1 / F.col("__p.mass"), F.lit(0.0)).alias("score"))
