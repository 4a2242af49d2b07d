"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions.text import STOP_WORDS, TERM, TERM_STOP_WORDS
from tessella.session import reachable

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a title, its first line."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "lang", "source")


def quoted(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_tokens(x: str) -> str:
    """The knowledge tokenizer in the oracle's SQL."""
    return f"list_filter(string_split_regex(regexp_replace(replace(lower({x}), '_', '-'), '[^a-z0-9-]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1 and not list_contains({quoted(STOP_WORDS)}, t))"


def sql_terms(x: str) -> str:
    """Query terms in the oracle's SQL, distinct in order."""
    raw = f"list_filter(regexp_extract_all(lower({x}), '{TERM}'), lambda t: not list_contains({quoted(TERM_STOP_WORDS)}, t))"
    return sql_distinct(raw) + "[1:64]"


def sql_distinct(x: str) -> str:
    return f"(select list(t order by i) from (select t, min(i) as i from (select unnest(l) as t, generate_subscripts(l, 1) as i from (select {x} as l)) group by t))"


#: The TF-IDF index and query terms, as common table expressions.
SQL_TFIDF = f"""
d as (select doc_id, split_part(text, chr(10), 1) as title, text as content, lang from documents),
tok as (select doc_id, unnest({sql_tokens('content')}) as term from d),
tf as (select doc_id, term, count(*) as tf from tok group by all),
tl as (select doc_id, list_distinct({sql_tokens('title')}) as l from d),
ti as (select doc_id, unnest(l) as term from tl),
tb as (select distinct doc_id, unnest(list_concat(l, list_filter(flatten(list_transform(l, lambda t: string_split(t, '-'))), lambda p: length(p) > 1))) as term from tl),
post as (select doc_id, term from tf union select doc_id, term from ti),
dfs as (select term, count(*) as df from post group by term)"""
SQL_SCORES = (
    SQL_TFIDF
    + f""",
q as (select item_id as query_id, {sql_tokens('text')} as l from benchmark),
w as (select query_id, n, term, count(*) as times from (select query_id, len(l) as n, unnest(l) as term from q) group by all),
cell as (select doc_id, term from tf union select doc_id, term from tb),
hit as (
  select w.query_id, w.n, c.doc_id, w.times, coalesce(tf.tf, 0) + case when tb.term is not null then 3 else 0 end as f, post.term is not null as candidate,
    ln((select count(*) from documents) / (coalesce(dfs.df, 0) + 1)) as idf
  from w join cell c on c.term = w.term left join tf on tf.doc_id = c.doc_id and tf.term = c.term left join tb on tb.doc_id = c.doc_id and tb.term = c.term
  left join post on post.doc_id = c.doc_id and post.term = c.term left join dfs on dfs.term = w.term),
score as (select query_id, doc_id, sum(times * f * idf) * (1 + sum(times) / any_value(n)) as score from hit group by query_id, doc_id having bool_or(candidate) and sum(times * f * idf) <> 0)"""
)
