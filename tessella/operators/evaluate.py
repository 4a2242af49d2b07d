"""Retrieval evaluation: per-query scores, macro metrics, percentiles, policy tuning and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.reporting import numbered_rows
from tessella.operators.segments import Segments
from tessella.session import durable


def ideal_gain(judgments: DataFrame, k: int) -> DataFrame:
    best = judgments.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))).where(F.col("r") <= k)
    return best.groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("r") + 1)).alias("idcg"))


def rank_metrics(results: DataFrame, judgments: DataFrame, *, k: int = 10) -> DataFrame:
    """query_id, hit, reciprocal_rank and ndcg for every judged query.

    results: query_id, id, rank; judgments: query_id, id, grade from 1.  hit is
    1 if any relevant row is among the first k; each relevant id counts once.
    """
    first = results.where(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = first.join(judgments.where("grade > 0"), ["query_id", "id"])
    gain = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"))
    out = ideal_gain(judgments, k).join(gain, "query_id", "left")
    return out.select(
        "query_id",
        F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg"),
    )


def score_queries(gold: DataFrame, results: DataFrame, judgments: DataFrame, *, k: int = 10) -> DataFrame:
    """The record of each gold query: classification, hit, reciprocal rank, nDCG, citation and slot counts.

    gold: query_id, answerable, abstained, expected_revision, hard_negative_paths;
    results: query_id, id, rank, path, revision_id, current, source_verified,
    span_verified; judgments: query_id, id, grade, path, revision_id.
    """
    seen = results.where(F.col("rank") <= k)
    cited = seen.join(judgments.select("query_id", "id", F.col("path").alias("jpath"), F.col("revision_id").alias("jrev")), ["query_id", "id"], "left")
    slots = cited.join(gold.select("query_id", "answerable", "expected_revision", "hard_negative_paths"), "query_id")
    historical = ~F.col("answerable") & F.coalesce(F.col("revision_id") == F.col("expected_revision"), F.lit(False))
    counted = slots.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hash_slots"),
        F.count_if(F.col("source_verified") & F.col("span_verified")).alias("verified_hash_slots"),
        F.count_if(historical).alias("historical_target_leaks"),
        F.count_if(~F.col("current") | historical).alias("noncurrent_or_historical_slots"),
        F.count_if(F.array_contains("hard_negative_paths", F.col("path"))).alias("hard_negative_slots"),
        F.bool_or(F.coalesce((F.col("path") == F.col("jpath")) & (F.col("revision_id") == F.col("jrev")) & F.col("source_verified") & F.col("span_verified") & F.col("current"), F.lit(False))).alias("cited"),
    )
    zero = ["hash_slots", "verified_hash_slots", "historical_target_leaks", "noncurrent_or_historical_slots", "hard_negative_slots"]
    out = gold.select("query_id", "answerable", "abstained").join(rank_metrics(results, judgments, k=k), "query_id", "left").join(counted, "query_id", "left")
    out = out.fillna(0, [*zero, "hit", "reciprocal_rank", "ndcg"])
    return out.withColumn("classification_correct", F.col("answerable") != F.col("abstained")).withColumn("citation_correct", F.when(F.col("answerable"), F.coalesce("cited", F.lit(False)))).drop("cited")


def macro_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Means over answerable queries, abstention over the others, and sums of slots; null where nothing counts."""
    answerable, other = F.col("answerable"), ~F.col("answerable")
    share = lambda c, where: F.avg(F.when(where, c.cast("double")))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"),
        share(F.col("hit"), answerable).alias("hit_at_k"),
        share(F.col("reciprocal_rank"), answerable).alias("mrr"),
        share(F.col("ndcg"), answerable).alias("ndcg"),
        share(F.col("citation_correct"), answerable).alias("citation_accuracy"),
        share(~F.col("abstained"), answerable).alias("acceptance"),
        share(F.col("abstained"), other).alias("negative_abstention"),
        share(F.col("classification_correct"), F.lit(True)).alias("classification_accuracy"),
        (F.sum("verified_hash_slots") / F.nullif(F.sum("hash_slots"), F.lit(0))).alias("hash_rate"),
        F.sum("noncurrent_or_historical_slots").alias("noncurrent_slots"),
        F.sum("hard_negative_slots").alias("hard_negative_slots"),
    )


def nearest_rank(value: Column, p: float) -> Column:
    """The value at place ceil(p * n) of the ascending values, an aggregate."""
    return F.percentile_disc(p).within_group(value) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) within group (order by {value})")


def floor_index(rows: DataFrame, by: str, value: str, places: dict[str, float]) -> DataFrame:
    """by and, for each name, the value at place int((n - 1) * p), from 0, of the group's ascending values, rounded to 3 digits.

    Values are counted first, so equal ones are one row; places are found in the
    running counts of the distinct ones, cut into segments where a group has many.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counts = durable(counts, "counts")
    cut = Segments(counts, by, "__v")
    upto = cut.done(cut.running_sum(cut.rows, F.col("__c"), "__upto"))
    sizes = counts.groupBy(by).agg(F.sum("__c").alias("__n"))
    at = lambda p: F.floor((F.col("__n") - 1) * p)
    return upto.join(sizes, by).groupBy(by).agg(*(F.round(F.min(F.when(F.col("__upto") > at(p), F.col("__v"))), 3).alias(name) for name, p in places.items()))


def threshold_grid(values: list[float], margins: list[float], spark) -> DataFrame:
    """exact_min <= agreement_min <= single_min by margin_min: the cross product of short lists."""
    out = spark.range(1).coalesce(1).drop("id")
    listed = lambda xs: F.explode(F.array(*(F.lit(float(x)) for x in xs)))
    out = out.select(listed(values).alias("exact_min")).select("*", listed(values).alias("agreement_min")).where("exact_min <= agreement_min")
    return out.select("*", listed(values).alias("single_min")).where("agreement_min <= single_min").select("*", listed(margins).alias("margin_min"))


def tune(grid: DataFrame, features: DataFrame, abstain: Column, *, negatives: float = 0.95, hits: float = 0.90) -> DataFrame:
    """The policy of the grid with the best objective, by its tuple: feasible, negative abstention, hits, accuracy, then the thresholds.

    features: answerable, hit and what `abstain` needs; the grid is a short list.
    """
    names = ["exact_min", "agreement_min", "single_min", "margin_min"]
    tried = features.crossJoin(F.broadcast(grid)).withColumn("abstained", abstain)
    share = lambda c, where: F.coalesce(F.avg(F.when(where, c.cast("double"))), F.lit(0.0))
    by = tried.groupBy(*names).agg(
        F.round(share(F.col("abstained"), ~F.col("answerable")), 9).alias("negative_abstention"),
        F.round(share(~F.col("abstained") & F.col("hit"), F.col("answerable")), 9).alias("hit_rate"),
        F.round(F.avg((F.col("abstained") != F.col("answerable")).cast("double")), 9).alias("accuracy"),
    )
    by = by.withColumn("feasible", (F.col("negative_abstention") >= negatives) & (F.col("hit_rate") >= hits))
    objective = F.struct("feasible", "negative_abstention", "hit_rate", "accuracy", "single_min", "agreement_min", "exact_min", "margin_min")
    return by.agg(F.max(objective).alias("o")).select("o.*")


def check_verdict(observed: Column, op: Column, threshold: Column) -> Column:
    """Whether observed op threshold holds; false for anything not finite, null for an unknown op."""
    finite = observed.isNotNull() & ~F.isnan(observed) & (F.abs(observed) != float("inf"))
    test = F.when(op == ">=", observed >= threshold).when(op == "<=", observed <= threshold).when(op == ">", observed > threshold).when(op == "<", observed < threshold).when(op == "==", observed == threshold)
    return F.when(test.isNotNull() | ~finite, finite & F.coalesce(test, F.lit(False)))


def gate(checks: DataFrame, *by: str) -> DataFrame:
    """passed iff no check failed; a name used twice is an error of its own."""
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("n_failed"), (F.count(F.lit(1)) - F.count_distinct("name")).alias("n_duplicate_names")
    ).withColumn("passed", (F.col("n_failed") == 0) & (F.col("n_duplicate_names") == 0))


def derived_threshold(scores: DataFrame, score: str, share: float = 0.98) -> DataFrame:
    return scores.agg((F.max(score) * share).alias("threshold"))


def candidate_thresholds(values: DataFrame, column: str) -> DataFrame:
    """Thresholds worth trying: fixed quantiles of the distinct values at 6 decimals, and a step beyond either end."""
    distinct = values.select(F.round(column, 6).alias("v")).where("v is not null").distinct()
    n = distinct.count()
    if not n:
        return values.sparkSession.createDataFrame([(0.0,)], "threshold double")
    places = sorted({0, n - 1, *(int(f * (n - 1)) for f in (0.1, 0.25, 0.5, 0.75, 0.9))})
    ranked = numbered_rows(distinct, "v").where(F.col("n").isin(places))
    tick = 1e-12
    ends = distinct.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.explode(F.array(F.col("lo") - tick, F.col("hi") + tick)).alias("threshold"))
    return ranked.select(F.col("v").alias("threshold")).unionByName(ends)


def overlap(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """query_id and the share of the first k that both lists have."""
    both = left.where(F.col("rank") <= k).select("query_id", "id").intersect(right.where(F.col("rank") <= k).select("query_id", "id"))
    return left.select("query_id").distinct().join(both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("overlap"))
