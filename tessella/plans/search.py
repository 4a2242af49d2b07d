"""Search, fusion and evaluation queries over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessella.functions import text as X
from tessella.operators import evaluate as E, index as I, search as S, vector as V
from tessella.session import durable, shared_dir, shared_path, spread
from tessella.plans.registry import SQL_SCORES, SQL_TFIDF, Registry, sql_terms, sql_tokens, table, titled

query = Registry()

#: Query vectors of the vector queries: every 20th point.
PROBE = 20


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def indexed(spark: SparkSession, sf_dir: str) -> I.Index:
    """The persisted index of documents: the first search builds it, later ones and other queries read it."""
    return I.opened(titled(spark, sf_dir), shared_dir(spark), I.documents_key(spark, f"{sf_dir}/documents.parquet"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.query_tokens(benchmark(spark, sf_dir))


@query(f"with {SQL_SCORES} select query_id, doc_id, score, rank from (select query_id, doc_id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, title, doc_id) as rank from score join d using (doc_id)) where rank <= 10")
def tfidf_search_topk(spark, sf_dir):
    return indexed(spark, sf_dir).tfidf(asked(spark, sf_dir), 10, "title", "doc_id", title=True)


@query(f"with {SQL_TFIDF} select term, df, round(ln((select count(*) from documents) / (df + 1)), 9) as idf from dfs")
def tfidf_idf_table(spark, sf_dir):
    docs = titled(spark, sf_dir)
    return S.idf_table(S.postings(docs), docs.count()).withColumn("idf", F.round("idf", 9))


@query(f"with {SQL_TFIDF} select df, count(*) as n_terms, min(term) as first_term from dfs group by df")
def inverted_index_stats(spark, sf_dir):
    return S.document_frequency(S.postings(titled(spark, sf_dir))).groupBy("df").agg(F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("first_term"))


@query(
    f"""with {SQL_SCORES},
top as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, title, doc_id) as rank from score join d using (doc_id) qualify rank <= 3),
p as (select t.query_id, t.doc_id, t.rank, d.content, list_min(list_filter(list_transform(q.l, lambda x: instr(lower(d.content), x)), lambda i: i > 0)) - 1 as pos from top t join d using (doc_id) join q using (query_id)),
s as (select *, greatest(0, pos - 200) as a, least(length(content), pos + 200) as b from p)
select query_id, doc_id, rank, case when pos is null then regexp_replace(content[1:400], '^\\s+|\\s+$', '', 'g') || case when length(regexp_replace(content[1:400], '^\\s+|\\s+$', '', 'g')) < length(content) then '...' else '' end
  else case when a > 0 then '...' else '' end || regexp_replace(content[a + 1:b], '^\\s+|\\s+$', '', 'g') || case when b < length(content) then '...' else '' end end as snippet from s"""
)
def search_snippet(spark, sf_dir):
    docs, queries = titled(spark, sf_dir), benchmark(spark, sf_dir)
    return S.snippets(indexed(spark, sf_dir).tfidf(asked(spark, sf_dir), 3, "title", "doc_id", title=True), docs, queries).select("query_id", "doc_id", "rank", "snippet")


@query(
    f"""with {SQL_SCORES},
wide as (select query_id, doc_id, lang, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as wide_rank from score join d using (doc_id) qualify wide_rank <= 40)
select query_id, doc_id, row_number() over (partition by query_id order by wide_rank) as rank from wide where lang = 'en' qualify rank <= 10"""
)
def search_tier_filter(spark, sf_dir):
    wide = indexed(spark, sf_dir).tfidf(asked(spark, sf_dir), 40, "doc_id").join(titled(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    return S.top_k(wide.where("lang = 'en'").withColumnRenamed("rank", "wide_rank"), 10, "wide_rank").select("query_id", "doc_id", "rank")


@query(f"select item_id as query_id, array_to_string(coalesce({sql_terms('text')}, []), ' ') as terms, len(coalesce({sql_terms('text')}, [])) as n_terms from benchmark")
def query_terms_extract(spark, sf_dir):
    terms = benchmark(spark, sf_dir).select("query_id", X.query_terms("text").alias("t"))
    return terms.select("query_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n_terms"))


@query(
    """with f as (select doc_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.:/@-]{0,127}'), lambda t: length(t) >= 4 and regexp_matches(t, '[0-9_.:/@-]')) as l from documents),
p as (select doc_id, unnest(l) as identifier, generate_subscripts(l, 1) as i from f), d as (select doc_id, identifier, min(i) as i from p group by doc_id, identifier)
select doc_id, identifier from d qualify row_number() over (partition by doc_id order by i) <= 64"""
)
def identifier_tokens(spark, sf_dir):
    """Of every document, the first 64 distinct identifiers."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(X.identifiers("text")).alias("identifier"))


@query("select p_partkey, regexp_replace(lower(trim(p_name)), '[\\s-]+', '-', 'g') as canonical, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from part")
def slug_and_canonical(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.canonical_name("p_name").alias("canonical"), X.slug_plain("p_name").alias("slug"))


BM25_SQL = f"""
d as (select doc_id, [lower(source)] as c1, [lower(lang)] as c2, {sql_tokens("split_part(text, chr(10), 1)")} as c3, {sql_tokens('text')} as c4 from documents),
z as (select doc_id, len(c1) + len(c2) + len(c3) + len(c4) as len from d),
u as (select doc_id, unnest(c1) as term, 8.0::double as w from d union all select doc_id, unnest(c2), 2.0 from d union all select doc_id, unnest(c3), 4.0 from d union all select doc_id, unnest(c4), 1.0 from d),
qt as (select distinct item_id as query_id, unnest({sql_tokens('text')}) as term from benchmark),
tf as (select doc_id, term, sum(w) as f from u where term in (select term from qt) group by all),
nn as (select term, count(*) as n from tf group by term),
cc as (select count(*) as total, avg(len) as av from z),
bm as (
  select query_id, doc_id, -sum((case when ln((total - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((total - n + 0.5) / (n + 0.5)) end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) as bm25
  from qt join tf using (term) join nn using (term) join z using (doc_id), cc group by all),
lex as (select query_id, doc_id, round(bm25, 6) as bm25, row_number() over (partition by query_id order by round(bm25, 6), doc_id) as rank from bm qualify rank <= 64)"""


@query(f"with {BM25_SQL} select query_id, doc_id, bm25, rank from lex where rank <= 10")
def bm25_search_topk(spark, sf_dir):
    return indexed(spark, sf_dir).bm25(asked(spark, sf_dir), 10, "doc_id")


@query(
    f"""with {SQL_SCORES}, {BM25_SQL.replace('d as (', 'bd as (', 1).replace(' from d ', ' from bd ').replace(' from d)', ' from bd)').replace(' from d', ' from bd').replace('from bdocuments', 'from documents').replace('tf as', 'btf as').replace('from tf ', 'from btf ').replace('join tf ', 'join btf ')},
vec as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from score qualify rank <= 64),
f as (select coalesce(v.query_id, l.query_id) as query_id, coalesce(v.doc_id, l.doc_id) as doc_id, v.rank as vector_rank, l.rank as lexical_rank, coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + l.rank), 0) as s from vec v full join lex l on v.query_id = l.query_id and v.doc_id = l.doc_id)
select query_id, doc_id, vector_rank, lexical_rank, round(s, 9) as fusion_score, row_number() over (partition by query_id order by round(s, 12) desc, doc_id) as fusion_rank from f qualify fusion_rank <= 96"""
)
def rrf_fusion(spark, sf_dir):
    index, terms = indexed(spark, sf_dir), asked(spark, sf_dir)
    fused = V.fuse(index.tfidf(terms, V.VECTOR, "doc_id"), index.bm25(terms, V.LEXICAL, "doc_id"), id_col="doc_id")
    return fused.select("query_id", "doc_id", "vector_rank", "lexical_rank", F.round("fusion_score", 9).alias("fusion_score"), "fusion_rank")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def probes(points_: DataFrame, every: int = PROBE) -> DataFrame:
    """The points that are queries; every: 1 takes all."""
    asked = points_ if every == 1 else points_.where(F.col("point_id") % every == 0)
    return asked.select(F.col("point_id").alias("query_id"), "vector", F.col("label").alias("query_label"))


def nearest(spark: SparkSession, sf_dir: str, k: int, keep=None) -> DataFrame:
    p = points(spark, sf_dir)
    return V.knn(p if keep is None else p.where(keep), probes(p), k=k)


SQL_KNN = f"""
e as (select vec_id, embedding::double[] as v, label, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
pair as (select q.vec_id as query_id, q.label as query_label, p.vec_id as id, p.label, round(list_dot_product(q.v, p.v) / (q.norm * p.norm), 5) as score from e q, e p where q.vec_id % {PROBE} = 0)"""


@query(f"with {SQL_KNN} select query_id, id, score + 0.0 as score, row_number() over (partition by query_id order by score desc, id) as rank from pair qualify rank <= 64")
def vector_knn_topk(spark, sf_dir):
    return nearest(spark, sf_dir, V.VECTOR)


def partition_index(spark: SparkSession, sf_dir: str) -> V.PartitionIndex:
    return V.PartitionIndex(points(spark, sf_dir), shared_path(spark, "vectors"))


@query(f"select count(*) as n_queries, true as reached from embeddings where vec_id % {PROBE} = 0")
def vector_index_recall(spark, sf_dir):
    """Whether the index finds nine tenths or more of every 20th point's ten nearest."""
    found = partition_index(spark, sf_dir).search(probes(points(spark, sf_dir)), 10)
    return V.recall(found, nearest(spark, sf_dir, 10)).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"with {SQL_KNN} select query_id, id, score + 0.0 as score, row_number() over (partition by query_id order by score desc, id) as rank from pair qualify rank <= 10")
def vector_index_exact(spark, sf_dir):
    """All lists probed: the exact result."""
    index = partition_index(spark, sf_dir)
    return index.search(probes(points(spark, sf_dir)), 10, probes=len(index.centroids))


@query(f"with {SQL_KNN} select query_id, id, score + 0.0 as score, row_number() over (partition by query_id order by score desc, id) as rank from pair where label = 1 qualify rank <= 20")
def vector_filtered_knn(spark, sf_dir):
    p = points(spark, sf_dir)
    return V.knn(V.equality_filters(p, label=1), probes(p), k=20)


SQL_TOP10 = f"{SQL_KNN}, top as (select query_id, query_label, id, label, score, row_number() over (partition by query_id order by score desc, id) as rank from pair where id <> query_id)"


def labelled_hits(spark: SparkSession, sf_dir: str, k: int = 64, every: int = PROBE) -> DataFrame:
    """Nearest other points with their labels and the query's."""
    p = points(spark, sf_dir)
    hits = V.knn(p, probes(p, every), k=k + 1).where("id <> query_id")
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    labels = p.select(F.col("point_id").alias("id"), "label")
    return hits.join(labels, "id").join(probes(p, every).select("query_id", "query_label"), "query_id")


@query(f"with {SQL_TOP10}, c as (select *, row_number() over (partition by query_id, label order by rank) as n from top where rank <= 64) select query_id, id, label, rank from c where n <= 2")
def per_group_cap(spark, sf_dir):
    return V.cap(labelled_hits(spark, sf_dir), "label").select("query_id", "id", "label", "rank")


@query(
    f"""with {SQL_TOP10}, m as (select query_id, max(case when rank = 1 then score end) as top_score, max(case when rank = 1 then score end) - max(case when rank = 2 then score end) as margin, bool_or(rank = 1 and label = query_label) as agree from top where rank <= 2 group by query_id)
select query_id, top_score, round(margin, 5) as margin, case when top_score is null then 'reranker-unavailable' when (agree and top_score >= 0.5 and margin >= 0.01) or (top_score >= 0.7 and margin >= 0.01) then null else 'below-calibrated-threshold' end as reason from m"""
)
def abstention_flags(spark, sf_dir):
    hits = labelled_hits(spark, sf_dir, 2)
    agree = hits.where("rank = 1").select("query_id", (F.col("label") == F.col("query_label")).alias("agree"))
    m = V.margins(hits).join(agree, "query_id")
    # The margin is a difference of 5-digit scores, so it is compared as one.
    m = m.withColumn("margin", F.round("margin", 5))
    reason = V.abstention(F.lit(True), F.col("top_score"), F.col("margin"), F.lit(False), F.col("agree"), 0.9, 0.5, 0.7, 0.01)
    return m.select("query_id", "top_score", "margin", reason.alias("reason"))


SQL_METRICS = f"""{SQL_TOP10}, hit as (select query_id, query_label, rank from top where rank <= 10 and label = query_label),
rel as (select q.vec_id as query_id, q.label as query_label, least(10, count(*) - 1) as n from e q join e p on p.label = q.label where q.vec_id % {PROBE} = 0 group by q.vec_id, q.label having count(*) > 1),
ideal as (select query_id, query_label, sum(1 / log2(r + 1)) as idcg from rel, range(1, 11) t(r) where r <= n group by all),
m as (select i.query_id, i.query_label, case when min(rank) is null then 0.0 else 1.0 end::double as hit, coalesce(1.0::double / min(rank), 0) as reciprocal_rank, coalesce(sum(1 / log2(rank + 1)), 0) / any_value(idcg) as ndcg from ideal i left join hit h on h.query_id = i.query_id group by i.query_id, i.query_label)"""


def judgments(points_: DataFrame, hits: DataFrame, k: int, every: int = PROBE) -> DataFrame:
    """query_id and id of relevant rows, the points of a query's label: those among its hits, and k of all, as the ideal has no more."""
    first = points_.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("point_id"))).where(F.col("n") <= k + 1)
    some = probes(points_, every).join(first.select(F.col("point_id").alias("id"), F.col("label").alias("query_label")), "query_label").where("id <> query_id")
    own = hits.where("label = query_label")
    return own.select("query_id", "id").unionByName(some.select("query_id", "id")).distinct()


def judged(spark: SparkSession, sf_dir: str, every: int = PROBE) -> DataFrame:
    p = points(spark, sf_dir)
    hits = durable(labelled_hits(spark, sf_dir, 10, every), "hits")
    truth = judgments(p, hits, 10, every).withColumn("grade", F.lit(1))
    return E.rank_metrics(hits.select("query_id", "id", "rank"), truth).join(probes(p, every).select("query_id", "query_label"), "query_id")


@query(f"with {SQL_METRICS} select query_id, hit, round(reciprocal_rank, 9) as reciprocal_rank, round(ndcg, 9) as ndcg from m")
def rank_metrics(spark, sf_dir):
    return judged(spark, sf_dir).select("query_id", "hit", F.round("reciprocal_rank", 9).alias("reciprocal_rank"), F.round("ndcg", 9).alias("ndcg"))


#: The metrics of all points as queries.
SQL_METRICS_ALL = SQL_METRICS.replace(f" where q.vec_id % {PROBE} = 0", "")


@query(f"with {SQL_METRICS_ALL} select query_label as label, count(*) as n_queries, round(avg(hit), 9) as hit, round(avg(reciprocal_rank), 9) as mrr, round(avg(ndcg), 9) as ndcg from m group by query_label")
def rank_metrics_by_category(spark, sf_dir):
    """Means over all points as queries, against all points."""
    r = lambda c, a: F.round(F.avg(c), 9).alias(a)
    return judged(spark, sf_dir, 1).groupBy(F.col("query_label").alias("label")).agg(F.count(F.lit(1)).alias("n_queries"), r("hit", "hit"), r("reciprocal_rank", "mrr"), r("ndcg", "ndcg"))


@query(
    f"""with {SQL_TOP10}, a as (select query_id, array_agg(id) as ids from top where rank <= 10 group by 1),
b0 as (select query_id, id, row_number() over (partition by query_id order by score desc, id) as r from top where label <> 1), b as (select query_id, array_agg(id) as ids from b0 where r <= 10 group by 1)
select query_id, len(list_intersect(a.ids, b.ids)) / 10 as overlap from a left join b using (query_id)"""
)
def overlap_at_10(spark, sf_dir):
    p = points(spark, sf_dir)
    full = labelled_hits(spark, sf_dir, 10)
    some = V.knn(p.where("label <> 1"), probes(p), k=11).where("id <> query_id")
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return E.overlap(full, some)


@query(
    """with g as (select v / 10.0::double as v from range(3, 9) t(v)), m as (select v / 100.0::double as v from range(0, 3) t(v)),
grid as (select e.v as exact_min, a.v as agreement_min, s.v as single_min, m.v as margin_min from g e, g a, g s, m where e.v <= a.v and a.v <= s.v),
"""
    + f"""{SQL_TOP10}, f as (select query_id, max(case when rank = 1 then score end) as top_score, round(max(case when rank = 1 then score end) - max(case when rank = 2 then score end), 5) as margin, bool_or(rank = 1 and label = query_label) as hit, any_value(query_id % 2 = 0) as answerable from top where rank <= 2 group by query_id),
t as (select g.*, f.*, not ((hit and top_score >= agreement_min and margin >= margin_min) or (top_score >= single_min and margin >= margin_min)) as abstained from grid g, f),
o as (select exact_min, agreement_min, single_min, margin_min, round(coalesce(avg(case when not answerable then abstained::int end), 0), 9) as negative_abstention, round(coalesce(avg(case when answerable then (not abstained and hit)::int end), 0), 9) as hit_rate, round(avg((abstained <> answerable)::int), 9) as accuracy from t group by all)
select (negative_abstention >= 0.95 and hit_rate >= 0.90) as feasible, negative_abstention, hit_rate, accuracy, single_min, agreement_min, exact_min, margin_min from o order by feasible desc, negative_abstention desc, hit_rate desc, accuracy desc, single_min desc, agreement_min desc, exact_min desc, margin_min desc limit 1"""
)
def threshold_grid_best(spark, sf_dir):
    hits = labelled_hits(spark, sf_dir, 2)
    hit = hits.where("rank = 1").select("query_id", (F.col("label") == F.col("query_label")).alias("hit"))
    features = V.margins(hits).join(hit, "query_id").withColumn("margin", F.round("margin", 5)).withColumn("answerable", F.col("query_id") % 2 == 0)
    grid = E.threshold_grid([i / 10 for i in range(3, 9)], [i / 100 for i in range(3)], spark)
    reason = V.abstention(F.lit(True), F.col("top_score"), F.col("margin"), F.lit(False), F.col("hit"), F.col("exact_min"), F.col("agreement_min"), F.col("single_min"), F.col("margin_min"))
    return E.tune(grid, features, reason.isNotNull())


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, round(list_sort(list(value))[(floor((count(*) - 1) * 0.95) + 1)::bigint], 3) as p95_floor, median(value) as median, min(value) as least, max(value) as most from events where value is not null group by event_type")
def latency_percentiles(spark, sf_dir):
    v = table(spark, sf_dir, "events").where("value is not null")
    floors = E.floor_index(v, "event_type", "value", {"p95_floor": 0.95})
    return v.groupBy("event_type").agg(
        F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most")
    ).join(floors, "event_type")


@query("select l1.l_orderkey, l1.l_linenumber as line_a, l2.l_linenumber as line_b from lineitem l1 join lineitem l2 on l1.l_orderkey = l2.l_orderkey and l1.l_linenumber < l2.l_linenumber where greatest(0, least(l1.l_quantity + l1.l_extendedprice / 1000, l2.l_quantity + l2.l_extendedprice / 1000) - greatest(l1.l_quantity, l2.l_quantity)) / (greatest(l1.l_quantity + l1.l_extendedprice / 1000, l2.l_quantity + l2.l_extendedprice / 1000) - least(l1.l_quantity, l2.l_quantity)) >= 0.8")
def span_iou_pairs(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"), (F.col("l_quantity") + F.col("l_extendedprice") / 1000).alias("e"))
    return V.iou_pairs(spans, "l_orderkey", "l_linenumber", "s", "e").select("l_orderkey", F.col("a").alias("line_a"), F.col("b").alias("line_b"))
