"""Usage, register and health reporting: grouped counts, islands, pivots, folds and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.operators.cycles import cyclic_edges
from tessella.operators.segments import Segments
from tessella.session import durable


def usage(log: DataFrame, *by: str, in_: str = "inputEst", out: str = "outputEst", ms: str = "ms", error: Column | None = None) -> DataFrame:
    """calls, in, out, rounded mean ms and errors; half a millisecond rounds up."""
    return log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(in_).alias("tokens_in"), F.sum(out).alias("tokens_out"), F.floor(F.avg(ms) + 0.5).cast("long").alias("avg_ms"), F.count_if(error if error is not None else F.col("isError")).alias("errors")
    )


def flag_rate(log: DataFrame, flag: Column, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged"), F.round(F.avg(flag.cast("double")), 6).alias("rate"))


def running_total(log: DataFrame, session: str, value: str, *order: str) -> DataFrame:
    """log with `running`, the session's sum up to each row; sessions of any size (see segments)."""
    cut = Segments(log, session, *order)
    return cut.done(cut.running_sum(cut.rows, F.col(value), "running"))


def first_crossing(log: DataFrame, session: str, value: str, threshold: float, *order: str) -> DataFrame:
    """The first row of each session whose running total reaches the threshold."""
    run = running_total(log, session, value, *order).where(F.col("running") >= threshold)
    return run.groupBy(F.col(session).alias("__s")).agg(F.min_by(F.struct(*run.columns), F.struct(*order)).alias("__r")).select("__r.*")


def islands(rows: DataFrame, group: str, place: Column, gap: float, *ties: str) -> DataFrame:
    """rows with `island`, from 0: a new one begins where the previous row is more than `gap` away; groups of any size (see segments)."""
    cut = Segments(rows.withColumn("__place", place), group, "__place", *ties)
    placed = cut.last_before(cut.rows, F.col("__place"), "__last")
    new = F.coalesce((F.col("__place") - F.col("__last") > gap).cast("int"), F.lit(0))
    return cut.done(cut.running_sum(placed, new, "island")).drop("__place", "__last")


def sequence_report(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Per group: rows, missing numbers between the least and largest, duplicates, and rows without a number."""
    agg = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("lo"), F.max(number).alias("hi"), F.count_distinct(number).alias("d"), F.count(number).alias("c"))
    missing = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("d"), F.lit(0)).cast("long")
    return agg.select(group, "n", missing.alias("n_missing"), (F.col("c") - F.col("d")).alias("n_duplicates"), (F.col("n") - F.col("c")).alias("n_unnumbered"))


def one_way_counts(df: DataFrame, *columns: str) -> DataFrame:
    """dimension, value and n of each column by itself: grouping sets in one pass."""
    grouped = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(columns)) - 1
    bit = lambda i: full ^ (1 << (len(columns) - 1 - i))
    dimension, value = F, F
    for i, c in enumerate(columns):
        dimension, value = dimension.when(F.col("g") == bit(i), c), value.when(F.col("g") == bit(i), F.col(c).cast("string"))
    return grouped.select(dimension.otherwise(F.lit(None)).alias("dimension"), value.otherwise(F.lit(None)).alias("value"), "n")


def crosstab(df: DataFrame, outer: str, inner: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts of each kind by outer and inner, with totals by rollup (null)."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(kind) == k).alias("n_" + k.lower().replace(" ", "_").replace("-", "_")) for k in kinds))


def before_after(rows: DataFrame, before: Column, value: str, least: int, *by: str) -> DataFrame:
    """Means before and after, their difference, and a verdict only where both sides have enough rows."""
    out = rows.groupBy(*by).agg(F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_after"), F.avg(F.when(before, F.col(value))).alias("mean_before"), F.avg(F.when(~before, F.col(value))).alias("mean_after"))
    delta = F.col("mean_after") - F.col("mean_before")
    return out.withColumn("delta", delta).withColumn("verdict", F.when((F.col("n_before") < least) | (F.col("n_after") < least), "insufficient").when(delta < 0, "lower").when(delta > 0, "higher").otherwise("equal"))


def bucket_shares(rows: DataFrame, bucket: str, cap: float) -> DataFrame:
    """n, share and whether the share is beyond the cap, of each bucket."""
    n = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("__t")))).select(bucket, "n", F.round(F.col("n") / F.col("__t"), 6).alias("share"), (F.col("n") / F.col("__t") > cap).alias("violation"))  # one row


def verdict_fold(checks: DataFrame, passed: Column, *by: str) -> DataFrame:
    """NO if any failed, UNCERTAIN if any is unmeasured (null), else YES."""
    return checks.groupBy(*by).agg(F.when(F.bool_or(~passed), "NO").when(F.bool_or(passed.isNull()), "UNCERTAIN").otherwise("YES").alias("verdict"))


def rice(reach: Column, impact: Column, confidence: Column, effort: Column) -> Column:
    return F.round(reach * impact * confidence / effort, 2)


def retention_pressure(count: Column, size: Column, warn: tuple[int, int] = (7, 6 << 30), alarm: tuple[int, int] = (14, 12 << 30)) -> Column:
    return F.when((count > alarm[0]) | (size > alarm[1]), "alarm").when((count > warn[0]) | (size > warn[1]), "warn").otherwise("ok")


def heat(share: Column) -> Column:
    """Band of a share of the peak."""
    return F.when(share >= 0.65, "hot").when(share >= 0.35, "warm").otherwise("cool")


def evenly_spaced(rows: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at places i * n // k of the order; ranges of the order number their rows, so no task sorts them all."""
    n = rows.count()
    places = sorted({i * n // k for i in range(k)} if n else set())
    numbered = numbered_rows(rows, order)
    return numbered.where(F.col("n").isin(places)).drop("n") if places else numbered.drop("n").limit(0)


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with `n`, from 0, in the order: rows are dealt by ranges, each range numbers its own, and the ranges' sizes are added up.

    The ranges come from samples, which each reading draws anew, so the rows with their ranges are a table.
    """
    ranged = durable(rows.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return ranged.withColumn("__r", local).join(F.broadcast(before), "__p").withColumn("n", F.col("__r") - 1 + F.col("__before")).drop("__p", "__r", "__before")  # a row a partition


def legal_moves(log: DataFrame, key: str, state: str, moves: list[tuple[str, str]], *order: str) -> DataFrame:
    """key, previous, state, n and legal of the pairs of states that follow each other."""
    pairs = log.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where("previous is not null").groupBy("previous", state).agg(F.count(F.lit(1)).alias("n"))
    table = log.sparkSession.createDataFrame([(a, b, True) for a, b in moves], f"previous string, {state} string, legal boolean")
    return pairs.join(F.broadcast(table), ["previous", state], "left").withColumn("legal", F.coalesce("legal", F.lit(False)) | (F.col("previous") == F.col(state)))  # a short list


def dependency_faults(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """key and fault: self, dangling or cycle; a cycle's members reach themselves, however long it is.  edges: key, dep; see cycles for the tables' sizes."""
    own = edges.where(F.col(key) == F.col("dep")).select(key, F.lit("self").alias("fault"))
    dangling = edges.join(rows.select(F.col(key).alias("dep")), "dep", "left_anti").select(key, F.lit("dangling").alias("fault"))
    live = edges.where(F.col(key) != F.col("dep")).join(rows.select(F.col(key).alias("dep")), "dep", "left_semi").select(F.col(key).alias("a"), F.col("dep").alias("b"))
    return own.unionByName(dangling).unionByName(cyclic_edges(live).select(F.col("a").alias(key), F.lit("cycle").alias("fault"))).distinct()


def unmet_dependencies(rows: DataFrame, edges: DataFrame, key: str, *, done: str = "complete") -> DataFrame:
    """key and dep of dependencies that are missing or not done."""
    state = rows.select(F.col(key).alias("dep"), F.col("status").alias("__s"))
    return edges.join(state, "dep", "left").where(F.col("__s").isNull() | (F.col("__s") != done)).select(key, "dep")


def issue_codes(**tests: Column) -> Column:
    """The codes whose count is not 0, in order; an aggregate's columns."""
    return F.array_compact(F.array(*(F.when(t > 0, F.lit(n)) for n, t in tests.items())))


def composite(components: DataFrame) -> DataFrame:
    """One row: healthy iff no component has an issue; components: component, state."""
    bad = F.col("state") != "ok"
    return components.agg(F.count(F.lit(1)).alias("n_components"), F.count_if(bad).alias("n_issues"), F.array_sort(F.collect_list(F.when(bad, F.concat_ws(":", "component", "state")))).alias("issues")).withColumn("healthy", F.col("n_issues") == 0)


def violations(rows: DataFrame, key: str, **tests: Column) -> DataFrame:
    """key and code of every test that a row fails."""
    codes = F.array_compact(F.array(*(F.when(t, F.lit(n.replace("_", "-"))) for n, t in tests.items())))
    return rows.select(key, F.explode(codes).alias("code"))


def drift(stored: DataFrame, generated: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """key and finding of rows that are missing, extra or changed, volatile columns aside."""
    columns = sorted(c for c in stored.columns if c != key and c not in volatile)
    a = stored.select(key, F.struct(*columns).alias("__a"))
    b = generated.select(key, F.struct(*columns).alias("__b"))
    out = a.join(b, key, "full")
    return out.select(key, F.when(F.col("__a").isNull(), "missing").when(F.col("__b").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed").alias("finding")).where("finding is not null")


def quality_gate(scores: DataFrame, by: str, dimension: str, score: str, *, mean: float, each: float, core: dict[str, float]) -> DataFrame:
    """by, mean and passed: a mean, a least score of any dimension, and least scores of core ones."""
    low = F.lit(False)
    for d, least in core.items():
        low = low | ((F.col(dimension) == d) & (F.col(score) < least))
    return scores.groupBy(by).agg(F.round(F.avg(score), 6).alias("mean"), F.min(score).alias("least"), F.bool_or(low).alias("core_low")).withColumn("passed", (F.col("mean") >= mean) & (F.col("least") >= each) & ~F.col("core_low"))


def acknowledgements(entries: DataFrame, ledger: DataFrame, now: Column, name: str = "name") -> DataFrame:
    """entries with `state`: acknowledged, or reopened because unknown, bound to another fingerprint, without a deadline or due."""
    acks = ledger.select(name, F.col("fingerprint").alias("__f"), F.col("deadline").alias("__d"), F.lit(True).alias("__k"))
    out = entries.join(acks, name, "left")
    why = F.when(F.col("__k").isNull(), "open").when(~F.col("__f").eqNullSafe(F.col("fingerprint")), "mismatch").when(F.col("__d").isNull(), "invalid").when(now >= F.col("__d"), "due").otherwise("acknowledged")
    return out.withColumn("state", why).drop("__f", "__d", "__k")


def temporal_facts(facts: DataFrame, needle: str, groups: list[str], limit: int, fields: list[str]) -> DataFrame:
    """Facts with the needle in any field, in approved groups, newest first: the first `limit` over groups in order."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(f), F.lit(needle.lower()))
    place = F.array_position(F.array(*map(F.lit, groups)), F.col("group_id"))
    return facts.where(F.col("group_id").isin(groups) & hit).withColumn("__g", place).orderBy("__g", F.desc_nulls_last("valid_at"), *fields).limit(limit).drop("__g")


def top_calls(log: DataFrame, k: int, value: str, arrival: str) -> DataFrame:
    """The k rows of the largest value; of equals those that came first."""
    return log.orderBy(F.desc_nulls_last(value), arrival).limit(k)


def timeline(records: DataFrame, *, label: str | None = None) -> DataFrame:
    """A replay of observed records (observed_at, event_id, label, ...): of one label if given, by time, then id; missing ones first."""
    kept = records if label is None else records.where(F.col("label") == label)
    return kept.orderBy(F.coalesce(F.col("observed_at").cast("string"), F.lit("")), F.coalesce("event_id", F.lit("")))


def duplicate_aliases(files: DataFrame, *, path: str = "path", real: str = "real_path", suffix: str = ".md") -> DataFrame:
    """real path, first path, n and sorted paths of every source that several listed paths resolve to."""
    named = files.where(F.lower(path).endswith(suffix)).select(F.col(real).alias("real_path"), F.col(path).alias("path")).distinct()
    groups = named.groupBy("real_path").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.array_sort(F.collect_list("path")).alias("paths"))
    return groups.where("n > 1").select("real_path", "first_path", "n", "paths")
