"""The read-only tool surface: list, get and search functions over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tessella.functions import markdown as M, text as X
from tessella.operators import classify as C, reporting as R, search as S, vector as V
from tessella.session import durable


def list_items(knowledge: DataFrame, tier: str) -> DataFrame:
    """name, title and description of a tier (skills, agents, references, guides, memory), by name."""
    return knowledge.where(F.col("tier") == tier).select("name", "title", "description").orderBy("name")


def get_item(knowledge: DataFrame, tier: str, name: str, section: str | None = None, mode: str = "auto") -> DataFrame:
    """The item whose canonical name, or whose only substring match, is meant: name, mode and text by the size policy."""
    rows = knowledge.where(F.col("tier") == tier)
    asked = knowledge.sparkSession.createDataFrame([(name,)], "query string")
    found = rows.join(C.name_lookup(rows.select("name"), asked).where("name is not null").select("name"), "name", "left_semi")
    policy = M.size_policy(F.col("content"), F.lit(section).cast("string"), F.lit(mode))
    out = found.withColumn("mode", policy).withColumn("section_text", F.lit(None).cast("string"))
    if section is not None:
        wanted = found.select("name", F.lit(section).alias("query"))
        cut = M.section_text(found, wanted, id_col="name", text_col="content").select("name", F.col("text").alias("section_text"))
        out = found.withColumn("mode", policy).join(cut, "name", "left")
    outline = M.outline_summary(found, id_col="name", text_col="content").select("name", F.concat_ws("\n", "lead", F.array_join("outline", "\n")).alias("outline_text"))
    text = F.when(F.col("mode") == "section", F.col("section_text")).when(F.col("mode") == "toc", F.col("outline_text")).otherwise(F.col("content"))
    return out.join(outline, "name", "left").select("name", "mode", text.alias("text"))


def get_guides(knowledge: DataFrame, topic: str) -> DataFrame:
    """All guides whose topic equals, contains or lies in the asked one."""
    q, t = F.lit(topic.strip().lower()), F.lower("name")
    return knowledge.where((F.col("tier") == "guides") & (F.contains(t, q) | F.contains(q, t))).select("name", "content").orderBy("name")


def search_knowledge(knowledge: DataFrame, query: str, max_results: int = 10) -> DataFrame:
    """TF-IDF search over all tiers: name, score, rank and snippet."""
    spark = knowledge.sparkSession
    docs = knowledge.withColumn("doc_id", F.concat_ws("/", "tier", "name"))
    asked = spark.createDataFrame([(1, query)], "query_id int, text string")
    hits = S.tfidf_search(docs, asked, k=max_results)
    return S.snippets(hits, docs, asked).select("doc_id", "score", "rank", "snippet").orderBy("rank")


def artifact_status(revisions: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Counts of a catalog's current revisions by kind, and of its checkpoint by sink, target and status."""
    a = revisions.groupBy(F.lit("catalog").alias("part"), F.col("artifact_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    b = checkpoint.groupBy(F.lit("checkpoint").alias("part"), F.concat_ws("/", "sink", "target", "status").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def search_artifacts(spans: DataFrame, queries: DataFrame, *, limit: int = 10, **filters: object) -> DataFrame:
    """Hybrid search of all queries: filtered vector and BM25 legs, fusion, collapse and a cap by artifact.

    spans: span_id, artifact_id, revision_id, span_sha256, start, end, vector,
    tokens (array) and filter columns; queries: query_id, text, vector.
    """
    if not 1 <= limit <= 25:
        raise ValueError("limit is 1 to 25")
    rows = V.equality_filters(spans, **filters)
    vector = V.knn(rows, queries, k=V.VECTOR, id_col="span_id", query_id="query_id")
    terms = queries.select("query_id", F.explode(X.query_terms("text")).alias("term"))
    lexical = S.bm25_top(rows, terms, [("tokens", 1.0)], V.LEXICAL)
    fused = V.fuse(vector, lexical)
    placed = fused.join(rows.select(F.col("span_id").alias("id"), "artifact_id", "revision_id", "span_sha256", "start", "end"), "id").withColumnRenamed("fusion_rank", "rank")
    kept = V.collapse(placed.select("query_id", "id", "rank", "revision_id", "span_sha256", "start", "end"))
    capped = V.cap(kept.join(placed.select("query_id", "id", "artifact_id", "fusion_score"), ["query_id", "id"]), "artifact_id")
    return S.top_k(capped.withColumnRenamed("rank", "fusion_rank"), limit, "fusion_rank")


MODES = ("vector", "lexical", "hybrid", "hybrid-rerank")
#: Reasons why a candidate is not a result.
NOT_CURRENT, NO_SOURCE, OTHER_HASH = "not-current", "source-missing", "span-hash-differs"


def retrieve(
    spans: DataFrame, queries: DataFrame, current: DataFrame, *, mode: str = "hybrid-rerank", limit: int = 10, scorer: V.Reranker | None = None, policy: dict[str, float] | None = None, **filters: object
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, decisions, failures) of a search whose results are read back from their sources before any is given.

    spans: span_id, artifact_id, revision_id, span_sha256, start, end (characters
    from 0), heading, content, vector, tokens (array), identifiers (array; without
    it, those of the candidates' content) and filter columns; queries: query_id, text, vector; current: artifact_id,
    revision_id and content of the catalog's current sources.

    Legs by mode, fusion, collapse; the scorer sees path, heading and content of
    the first candidates that are left.  A candidate counts if its revision is the
    artifact's current one and the source's text at its place has its hash; of
    these, each artifact has two at most.  With a policy (exact_identifier_cross_min,
    agreement_cross_min, single_channel_cross_min, cross_margin_min) a query is
    answered only if the first verified candidate passes it.

    results: query_id, rank, id, artifact_id, ... of answered queries.  decisions:
    a row a query with its counts, features, abstained and reason.  failures:
    query_id, id and reason.
    """
    if mode not in MODES or not 1 <= limit <= 25:
        raise ValueError(f"mode is one of {MODES}, and limit 1 to 25")
    if mode == "hybrid-rerank" and scorer is None:
        raise ValueError("hybrid-rerank needs a scorer")
    rows = V.equality_filters(spans, **filters)
    asked = queries.select("query_id", X.safe_query("text").alias("text"), "vector")
    terms = asked.select("query_id", F.explode(X.query_terms("text")).alias("term"))
    none = spans.sparkSession.createDataFrame([], T.StructType([asked.schema["query_id"], T.StructField("id", spans.schema["span_id"].dataType), T.StructField("rank", T.IntegerType())]))
    vector = none if mode == "lexical" else V.knn(rows, asked, k=V.VECTOR, id_col="span_id", query_id="query_id")
    lexical = none if mode == "vector" else S.bm25_top(rows, terms, [("tokens", 1.0)], V.LEXICAL)
    fused = durable(V.fuse(vector.select("query_id", "id", "rank"), lexical.select("query_id", "id", "rank")), "fused")
    given = [c for c in ("identifiers",) if c in rows.columns]
    named = rows.select(F.col("span_id").alias("id"), "artifact_id", "revision_id", "span_sha256", "start", "end", "heading", "content", *given)
    placed = fused.join(named, "id").withColumnRenamed("fusion_rank", "rank")
    placed = durable(placed if given else placed.withColumn("identifiers", X.identifiers("content")), "placed")
    kept = V.collapse(placed.select("query_id", "id", "rank", "revision_id", "span_sha256", "start", "end"))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).drop("rank")
    left = kept.join(placed.withColumnRenamed("rank", "fusion_rank"), ["query_id", "id"]).join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    if mode == "hybrid-rerank":
        text = F.concat_ws("\n", F.coalesce(F.col("artifact_id").cast("string"), F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("content", F.lit("")))
        ranked = V.rerank(left.withColumn("content", text), scorer, place="place")
    else:
        ranked = left.withColumns({"cross_score": F.lit(None).cast("double"), "cross_rank": F.lit(None).cast("int"), "final_rank": F.col("place")})
    ranked = durable(ranked, "ranked")
    # Sources of the candidates only are read, and each span is hashed where it is cut.
    now = current.select("artifact_id", F.col("revision_id").alias("__revision"), F.col("content").alias("__source")).join(ranked.select("artifact_id").distinct(), "artifact_id", "left_semi")
    cut = F.sha2(F.substring(F.col("__source"), F.col("start") + 1, F.col("end") - F.col("start")), 256)
    state = F.when(~F.col("revision_id").eqNullSafe(F.col("__revision")), NOT_CURRENT).when(F.col("__source").isNull(), NO_SOURCE).when(cut != F.col("span_sha256"), OTHER_HASH)
    checked = durable(ranked.join(now, "artifact_id", "left").withColumn("reason", state).drop("__source", "__revision", "content"), "checked")
    good = V.cap(checked, "artifact_id", verified=F.col("reason").isNull(), rank="final_rank")
    good = good.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("final_rank"))).where(F.col("rank") <= (max(limit, 2) if policy else limit))
    good = durable(good, "verified")
    exact = F.exists(F.filter(X.query_terms("query"), lambda t: t.rlike(X.IDENTIFIER)), lambda t: F.array_contains("identifiers", t))
    first = good.where("rank = 1").select("query_id", "cross_score", F.coalesce(exact, F.lit(False)).alias("exact"), (F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull()).alias("agree"))
    margin = good.where("rank = 2").select("query_id", F.col("cross_score").alias("__second"))
    counts = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    decided = asked.select("query_id")
    for df, name in ((fused, "n_union"), (kept, "n_collapsed"), (good, "n_verified"), (checked.where("reason is not null"), "n_failed")):
        decided = decided.join(counts(df, name), "query_id", "left")
    decided = decided.na.fill(0, ["n_union", "n_collapsed", "n_verified", "n_failed"]).join(first, "query_id", "left").join(margin, "query_id", "left")
    decided = decided.withColumn("cross_margin", F.col("cross_score") - F.col("__second")).drop("__second").na.fill(False, ["exact", "agree"])
    has = F.col("n_verified") > 0
    why = F.when(~has, "no-candidate")
    if policy:
        limits = [policy[k] for k in ("exact_identifier_cross_min", "agreement_cross_min", "single_channel_cross_min", "cross_margin_min")]
        why = V.abstention(has, F.col("cross_score"), F.col("cross_margin"), F.col("exact"), F.col("agree"), *limits)
    reason = F.when(~has & (F.col("n_failed") > 0), "no-verified-result").otherwise(why)
    decided = durable(decided.withColumn("reason", reason).withColumn("abstained", F.col("reason").isNotNull()), "decided")
    answered = good.where(F.col("rank") <= limit).join(decided.where("not abstained").select("query_id"), "query_id", "left_semi")
    results = answered.select("query_id", "rank", "id", "artifact_id", "revision_id", "span_sha256", "alternates", "vector_rank", "lexical_rank", "fusion_rank", "cross_score", "cross_rank", "final_rank")
    return results, decided, checked.where("reason is not null").select("query_id", "id", "reason")


def get_artifact(documents: DataFrame, path: str, max_chars: int = 12_000) -> DataFrame:
    """A document by path: content up to max_chars (256 to 50 000), whether it is cut, and whether its hash still holds."""
    if not 256 <= max_chars <= 50_000:
        raise ValueError("max_chars is 256 to 50000")
    c = F.col("content")
    return documents.where(F.col("relative_path") == path).select("relative_path", F.substring(c, 1, max_chars).alias("content"), (F.length(c) > max_chars).alias("truncated"), (F.sha2(c, 256) == F.col("content_sha256")).alias("verified"))


def get_facts(facts: DataFrame, query: str, groups: list[str], limit: int = 20) -> DataFrame:
    return R.temporal_facts(facts, query, groups, limit, ["src", "rel", "dst", "fact"])


def token_stats(log: DataFrame, mode: str = "summary") -> DataFrame:
    """Usage by tool; detail adds the five hottest calls."""
    by_tool = R.usage(log, "tool").withColumn("args", F.lit(None).cast("string"))
    if mode == "summary":
        return by_tool
    hot = R.usage(log, "tool", "args").orderBy(F.desc(F.col("tokens_out")), "tool", "args").limit(5)
    return by_tool.unionByName(hot.select(*by_tool.columns))
