"""Mixing sources to target weights by hierarchical budgets.

A budget flows from the root through a tree of levels (domain, language,
source): at each node the children get shares by weight; one that cannot use
its share is filled, and what it leaves goes to its siblings; only what all
siblings together cannot use is missed at the level above, whose children were
filled in the same way.  Each leaf then takes the prefix of its documents, in a
seeded order by epoch, whose tokens fit its budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.llm import common

#: A leaf's prefix sums run over buckets of its order, by leading hex digits, then inside one: so many rows a bucket at most, by expectation.
BUCKET_ROWS = 50_000
#: Leaves whose cuts are broadcast at most.
LEAVES = 100_000


def fill(nodes: DataFrame, parent: Sequence[str], child: str, capacity: str, weight: str, budget: str) -> DataFrame:
    """nodes with `share`: budget of a parent dealt to its children by weight, up to each one's capacity.

    With children by ascending capacity / weight, the first ones are filled
    whole; the others get weight * level, where level is the rest of the budget
    by the rest of the weights.
    """
    each = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = each.orderBy(F.col(capacity) / F.col(weight), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("__used", F.coalesce(F.sum(capacity).over(before), F.lit(0.0)))
    nodes = nodes.withColumn("__level", (F.col(budget) - F.col("__used")) / (F.sum(weight).over(each) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))))
    open_ = F.min(F.when(F.col("__level") * F.col(weight) <= F.col(capacity), F.struct((F.col(capacity) / F.col(weight)).alias("r"), F.col(child).alias("c"), F.col("__level").alias("level")))).over(each)
    nodes = nodes.withColumn("__cut", open_["level"])
    share = F.when(F.col("__cut").isNull(), F.col(capacity)).otherwise(F.least(F.col(capacity), F.greatest(F.lit(0.0), F.col("__cut")) * F.col(weight)))
    return nodes.withColumn("share", share).drop("__used", "__level", "__cut")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: dict[str, dict[str, float]], total: float | Column, epochs: int) -> DataFrame:
    """leaves (levels, tokens) with `budget`, in tokens: a long."""
    level_weight = lambda level: F.coalesce(_lookup(weights.get(level, {}), level), F.lit(1.0))
    nodes = leaves.withColumn("__capacity", F.col("tokens").cast("double") * epochs).withColumn("__budget", F.lit(total).cast("double") if not isinstance(total, Column) else total)
    for depth, level in enumerate(levels):
        parent, group = list(levels[:depth]), list(levels[: depth + 1])
        inner = nodes.groupBy(*group).agg(F.sum("__capacity").alias("cap"), F.max("__budget").alias("bud")).withColumn("w", level_weight(level))
        dealt = fill(inner, parent, level, "cap", "w", "bud").select(*group, "share")
        nodes = nodes.join(dealt, group).drop("__budget").withColumnRenamed("share", "__budget")
    return nodes.withColumn("budget", F.floor(F.col("__budget") + 1e-6).cast("long")).drop("__budget", "__capacity")


def _lookup(weights: dict[str, float], level: str) -> Column:
    out = F.lit(None).cast("double")
    for k, w in weights.items():
        out = F.when(F.col(level) == k, F.lit(float(w))).otherwise(out)
    return out


def order_key(id_col: str, seed: int, epoch: Column) -> Column:
    """A seeded order of an epoch: 16 hex digits, drawn anew for each epoch."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 16)


def mix_sources(
    df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], tokens: Column, *, id_col: str = "doc_id", total: float | None = None, share: float = 1.0, epochs: int = 1, seed: int = 0
) -> DataFrame:
    """df's columns with the levels' values (prefixed mix_), mix_tokens and mix_copies: how often a row is in the mixture, 0 for rows left out.

    total: tokens of the mixture; else `share` of all there are.  epochs: how
    often a document can be used.  Values without a weight weigh 1; null values
    are the leaf `none`.  A leaf takes whole epochs while they fit, then the
    prefix of the next whose running tokens fit; rows equal in order and id are
    in or out together.  Rows without tokens come for free when their place in
    the order is reached.  Null tokens count 0; very long texts are only
    counted.  An empty table gives no rows.  Input columns that bear the names of
    the result's own are an error; all others are carried on.
    """
    names = [f"mix_{n}" for n in levels]
    if taken := {*names, "mix_tokens", "mix_copies"} & set(df.columns):
        raise ValueError(f"mix_sources() makes columns of the names {sorted(taken)}")
    for name, column in levels.items():
        df = df.withColumn(f"mix_{name}", F.coalesce(column.cast("string"), F.lit("none")))
    df = df.withColumn("mix_tokens", F.coalesce(tokens, F.lit(0)).cast("long"))
    narrow = common.written(df.select(F.col(id_col).alias("__id"), *names, "mix_tokens"), "mixing")
    leaves = narrow.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    if total is None:
        total = float((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    planned = budgets(leaves, names, {f"mix_{k}": v for k, v in weights.items()}, total, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))))).otherwise(F.lit(epochs)).cast("long")
    planned = planned.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") < epochs, F.col("budget") - F.col("whole") * F.col("tokens")))
    digits = F.least(F.lit(8), F.greatest(F.lit(1), F.ceil(F.log(16.0, F.greatest(F.col("n_rows") / BUCKET_ROWS, F.lit(1.0)))))).cast("int")
    planned = common.written(planned.withColumn("digits", digits), "budgets")

    few = planned.count() <= LEAVES
    small = lambda d: F.broadcast(d) if few else d
    # The epoch's order is by leaf: each one's partial epoch has a number of its own.
    placed = narrow.join(small(planned.where("rest is not null").select(*names, "whole", "rest", "digits")), names).withColumn("key", order_key("__id", seed, F.col("whole"))).withColumn("bucket", F.substr("key", F.lit(1), F.col("digits")))
    sums = placed.groupBy(*names, "rest", "bucket").agg(F.sum("mix_tokens").alias("t"))
    run = Window.partitionBy(*names).orderBy("bucket")  # a row a bucket: 16 for a leaf of up to 800,000 rows
    sums = sums.withColumn("upto", F.sum("t").over(run)).withColumn("left", F.col("rest") - F.col("upto") + F.col("t"))
    edge = sums.where("upto > rest").groupBy(*names).agg(F.min(F.struct("bucket", "left")).alias("e")).select(*names, "e.bucket", "e.left")
    inside = placed.join(small(edge), [*names, "bucket"])
    within = Window.partitionBy(*names, "bucket").orderBy("key", F.col("__id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("mix_tokens").over(within)).where("upto > left")
    # The first place that does not fit ends the prefix.
    first_out = inside.groupBy(*names).agg(F.min(F.struct("key", F.col("__id").alias("at"))).alias("cut"))
    cut = planned.join(first_out, names, "left").select(*names, F.col("whole").alias("__mix_whole"), F.col("rest").isNotNull().alias("__mix_partial"), F.col("cut.key").alias("__mix_key"), F.col("cut.at").alias("__mix_id"))
    cut = common.written(cut, "cuts")
    key, cut_key, cut_id = order_key(id_col, seed, F.col("__mix_whole")), F.col("__mix_key"), F.col("__mix_id")
    earlier = F.coalesce(F.col(id_col) < cut_id, F.col(id_col).isNull() & cut_id.isNotNull())
    taken = F.col("__mix_partial") & (cut_key.isNull() | (key < cut_key) | ((key == cut_key) & earlier))
    return df.join(small(cut), names).select(*df.columns, (F.col("__mix_whole") + taken.cast("long")).alias("mix_copies"))
