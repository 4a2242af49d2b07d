"""The corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  A stage decides on ids and lengths and then
filters its input, so texts are read again rather than shuffled.

Every stage works on whole texts of any length; a null text counts as empty.
Columns beside doc_id, text, lang and source, of any name, are carried on.  An
empty table gives an empty one.  The module is part of tessella.llm and needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessella.llm import catalog, common, dedup, langid, mixing, nearjoin, packing

#: Probability from which on the language classifier's word is taken against a document's label.
CONFIDENT = 0.999
#: Share of the words left by dedup that the mixture takes; each document once at most.
MIXED = 0.9

#: Packing and language ID are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled rows that are not held out, does not reject.

    It rejects texts without a letter, and those it is sure (CONFIDENT) to be in
    another language than their label says.  A document without a label gets the
    predicted one, which the mixture then goes by; a label that the classifier
    has not learned stays, as do all texts with a letter where no row has a
    label.  Rows are judged one by one, so null or repeated ids and repeated rows
    stay as they are.
    """
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    whole = F.struct(*docs.columns).alias("__row")
    named = langid.identify(docs.select(whole), model, text_col="__row.text", keep=["__row"])
    row, pred = F.col("__row"), F.col("lang_pred")
    if model.languages:
        sure = row["lang"].isin(model.languages) & (row["lang"] != pred) & (F.col("score") >= CONFIDENT)
        named = named.where((pred != langid.UNDETERMINED) & ~F.coalesce(sure, F.lit(False)))
    else:
        named = named.where(F.coalesce(row["text"], F.lit("")).rlike(r"\p{L}")).withColumn("lang_pred", F.lit(None).cast("string"))
    return named.select(*(F.coalesce(row["lang"], "lang_pred").alias(c) if c == "lang" else row[c].alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows equal in id and text, one.

    Null and empty texts are equal.  A null id is smaller than any other.  Rows go
    by id and text, so an id that is null or stands for several texts loses none.
    Of rows that are equal in both, the first by their columns as JSON stays.
    """
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = common.written(dedup.exact_dedup(docs).select(F.struct("doc_id", F.unhex("text_sha256")).alias("row"), first.alias("first"), "kept"), "marked")
    named = docs.withColumn("__row", F.struct("doc_id", F.unhex(F.sha2(common.text_or_empty("text"), 256))))
    left = common.matched(named, marked.where("not first").select(F.col("row").alias("__row")), "__row", "left_anti")
    if not marked.where("first and not kept").isEmpty():
        # Of rows that differ in other columns only, the first in the order of their JSON.
        whole = F.struct(*docs.columns)
        left = left.groupBy("__row").agg(F.min_by(whole, F.to_json(whole)).alias("__kept")).select("__kept.*")
    return left.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id; texts without words stay.

    A row whose id is null or that of several rows is a document of its own and
    gives way to the others of its group; rows equal in id and text are one.  Ids
    that are not integers go by their order as text where an id is null or repeated.
    """
    key, rows = "doc_id", docs
    several = common.written(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "several")
    if not several.isEmpty():
        key = "__near_node"
        own, named = F.lit(1 << 62) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)), F.col("doc_id")
        if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
            # Beside ids of another type the numbers are strings, after all ids in order.
            own, named = F.concat(F.lit("\U0010ffff"), own.cast("string")), F.col("doc_id").cast("string")
        odd = several.select(F.col("doc_id").alias("__near_id"), F.lit(True).alias("__near_odd"))
        rows = docs.join(odd, F.col("doc_id").eqNullSafe(F.col("__near_id")), "left").withColumn(key, F.when(F.col("__near_odd"), own).otherwise(named))
    groups = common.written(nearjoin.jaccard_components(rows, id_col=key), "groups")
    gone = groups.where(F.col(key) != F.col("component_id")).select(key)
    return common.matched(rows, gone, key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by domain, language and source.

    Null languages and sources are leaves of their own.  Rows of one id, null too,
    share a place in the order and are in or out together; rows without words come
    for free when their place is reached.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "lang", "source", F.regexp_count("text", F.lit(common.WORD)).alias("n"))
    mixed = mixing.mix_sources(rows, catalog.tree(), catalog.WEIGHTS, F.col("n"), share=MIXED, seed=catalog.SEED)
    return mixed.where("mix_copies > 0").select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; every row is a document of its own, whatever its id."""
    pieces = packing.pack_documents(docs, catalog.tokenizer_path(catalog.WORDS))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
        common.give_back()
    return STAGES[-1][1](spark, docs, sf_dir)
