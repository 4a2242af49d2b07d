"""Running folds over groups of any size: hot groups are cut into segments, folded each by itself, and carried on.

A group is hot beyond HOT rows.  The rows of hot groups are dealt by ranges of
(group, order), and a range is a segment, so a window over (group, segment) has a
bounded number of rows.  What a segment takes over from those before it comes from
one row a segment.  Without a hot group all this is the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.search import few
from tessella.session import durable

#: Rows of a group beyond which it is cut.
HOT = 1_000_000
SEGMENT = "__segment"


class Segments:
    """rows of df with a segment number; fold and carry are by `group`, in the order of the columns `order`.

    Null groups are a group.  Rows that tie in all of `order` have no order among
    themselves, as in a window.  sizes: a table of at least as many rows a group
    that is cheaper to count.
    """

    def __init__(self, df: DataFrame, group: str, *order: str, sizes: DataFrame | None = None):
        self.group, self.order = group, order
        # Map-side counts: one row a group and task is shuffled.
        counted = (df if sizes is None else sizes).groupBy(F.struct(group).alias("__seg_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
        n, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.cut = n > 0
        if not self.cut:
            self.rows = df.withColumn(SEGMENT, F.lit(0))
            return
        hot = durable(counted, "hot")
        keyed = df.withColumn("__seg_key", F.struct(group))
        keys = few(hot.select("__seg_key"), n)
        ranged = keyed.join(keys, "__seg_key", "left_semi").drop("__seg_key").repartitionByRange(2 * -(-total // HOT), group, *order)
        # Written, so that a segment is the same rows wherever it is read.
        self.hot = durable(ranged.withColumn(SEGMENT, F.spark_partition_id()), "segments")
        self.rows = keyed.join(keys, "__seg_key", "left_anti").drop("__seg_key").withColumn(SEGMENT, F.lit(0)).unionByName(self.hot)

    def window(self):
        """The rows of a group's segment up to the current one."""
        return Window.partitionBy(self.group, SEGMENT).orderBy(*self.order)

    def carried(self, rows: DataFrame, **folds: tuple[Column, str, bool]) -> DataFrame:
        """rows with, for each name, what the segments before theirs leave: (an aggregate of a segment, how these are folded: sum or last, null as 0)."""
        if not self.cut:
            return rows.withColumns({name: F.lit(0) if zero else F.lit(None) for name, (_, _, zero) in folds.items()})
        before = Window.partitionBy(self.group).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        hot = rows.join(few(self.hot.select(F.struct(self.group).alias("__seg_key")).distinct()), F.struct(self.group).eqNullSafe(F.col("__seg_key")), "left_semi")
        summary = hot.groupBy(self.group, SEGMENT).agg(*(agg.alias(name) for name, (agg, _, _) in folds.items()))
        each = {name: (F.sum(name) if fold == "sum" else F.last(name, ignorenulls=True)).over(before) for name, (_, fold, _) in folds.items()}
        summary = summary.withColumns({f"__{name}": c for name, c in each.items()}).select(F.struct(self.group, SEGMENT).alias("__seg_at"), *(F.coalesce(f"__{n}", F.lit(0)).alias(n) if zero else F.col(f"__{n}").alias(n) for n, (_, _, zero) in folds.items()))
        summary = durable(summary, "carried")
        out = rows.join(few(summary), F.struct(self.group, SEGMENT).eqNullSafe(F.col("__seg_at")), "left").drop("__seg_at")
        return out.withColumns({n: F.coalesce(n, F.lit(0)) for n, (_, _, zero) in folds.items() if zero})

    def running_sum(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with the sum of value over the group's rows up to each."""
        held = rows.withColumn("__seg_value", value)
        local = held.withColumn("__seg_local", F.sum("__seg_value").over(self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if not self.cut:
            return local.withColumnRenamed("__seg_local", name).drop("__seg_value")
        return self.carried(local, __seg_before=(F.sum("__seg_value"), "sum", True)).withColumn(name, F.col("__seg_local") + F.col("__seg_before")).drop("__seg_value", "__seg_local", "__seg_before")

    def last_before(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with the value of the row before, in the group's order; null at its first."""
        held = rows.withColumn("__seg_value", value)
        local = held.withColumn("__seg_local", F.lag(F.struct("__seg_value")).over(self.window()))
        if not self.cut:
            return local.withColumn(name, F.col("__seg_local.__seg_value")).drop("__seg_value", "__seg_local")
        end = F.max_by(F.struct("__seg_value"), F.struct(*self.order))
        return self.carried(local, __seg_before=(end, "last", False)).withColumn(name, F.coalesce("__seg_local", "__seg_before")["__seg_value"]).drop("__seg_value", "__seg_local", "__seg_before")

    def last_known(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """rows with the last value that is not null among the group's rows up to each."""
        held = rows.withColumn("__seg_value", value)
        local = held.withColumn("__seg_local", F.last("__seg_value", ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        if not self.cut:
            return local.withColumnRenamed("__seg_local", name).drop("__seg_value")
        end = F.max_by("__seg_value", F.when(F.col("__seg_value").isNotNull(), F.struct(*self.order)))
        return self.carried(local, __seg_before=(end, "last", False)).withColumn(name, F.coalesce("__seg_local", "__seg_before")).drop("__seg_value", "__seg_local", "__seg_before")

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop(SEGMENT)
