"""Which edges of a graph lie on cycles, with tables that never exceed the edges.

Vertices with at most one edge in or at most one out are taken out, a round for
many at once: those that stand before their neighbours by a hash.  Each pair of an
edge in and an edge out becomes a bypass, which is no more edges than before.  A
bypass lies on a cycle exactly if both its parts do, so what is known of the small
graph goes back round by round.  Chains and cycles of n vertices shrink to nothing
in some log n rounds.  What is left, where every vertex has two edges in and two
out, is coloured: the largest vertex that reaches each one, forward, and from the
largest of each colour back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.session import durable


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """a, b: the edges (a, b) that lie on a cycle, loops included.  Nulls have no edges; repeated edges are one."""
    live = durable(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    n = live.count()
    while n:
        before, loops = live, live.where("a = b")
        live, bypass = _contracted(live.where("a <> b"), len(rounds))
        rounds.append((before, loops, bypass))
        now = live.count()
        if bypass is None:
            break
        n = now
    cyclic = _coloured(live) if n else live
    for before, loops, bypass in reversed(rounds):
        if bypass is not None:
            on = bypass.join(cyclic.select(F.col("a").alias("u"), F.col("b").alias("w")), ["u", "w"], "left_semi")
            parts = on.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("w").alias("b")))).alias("e")).select("e.a", "e.b")
            cyclic = cyclic.unionByName(parts)
        # Bypasses that were no edges before are gone again.
        cyclic = durable(cyclic.unionByName(loops).distinct().join(before, ["a", "b"], "left_semi"), "cyclic")
    return cyclic


def _contracted(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges without a set of vertices no two of which are neighbours; the bypasses u, v, w over each such v), or (edges, None) if no vertex can go."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    able = durable(ends.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).where("o <= 1 or i <= 1").select("v", F.struct(F.xxhash64("v", F.lit(number)).alias("h"), "v").alias("p")), "able")
    if able.isEmpty():
        return edges, None
    named = lambda c: able.select(F.col("v").alias(c), F.col("p").alias(f"p_{c}"))
    met = edges.join(named("a"), "a").join(named("b"), "b").select(F.when(F.col("p_a") < F.col("p_b"), F.col("a")).otherwise(F.col("b")).alias("v"))
    chosen = durable(able.select("v").join(met, "v", "left_anti"), "chosen")
    into = edges.join(chosen.withColumnRenamed("v", "b"), "b", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"))
    out = edges.join(chosen.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("a").alias("v"), F.col("b").alias("w"))
    bypass = durable(into.join(out, "v").select("u", "v", "w"), "bypass")
    rest = edges.join(chosen.withColumnRenamed("v", "a"), "a", "left_anti").join(chosen.withColumnRenamed("v", "b"), "b", "left_anti")
    return durable(rest.unionByName(bypass.select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct(), "edges"), bypass


def _coloured(edges: DataFrame) -> DataFrame:
    """The edges within strongly connected components of several vertices, or loops, by forward and backward colouring."""
    found, live = edges.where("a = b"), edges.where("a <> b")
    while not live.isEmpty():
        colour = durable(live.select(F.col("a").alias("v")).unionByName(live.select(F.col("b").alias("v"))).distinct().select("v", F.col("v").alias("c")), "colour")
        moved = True
        while moved:
            reached = live.join(colour.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.max("c").alias("n"))
            now = durable(colour.join(reached, "v", "left").select("v", F.greatest("c", "n").alias("c"), (F.coalesce("n", "c") > F.col("c")).alias("m")), "colour")
            moved = not now.where("m").isEmpty()
            colour = now.select("v", "c")
        a, b = (colour.select(F.col("v").alias(x), F.col("c").alias(f"c_{x}")) for x in "ab")
        inner = durable(live.join(a, "a").join(b, "b").where("c_a = c_b").select("a", "b", F.col("c_a").alias("c")), "inner")
        # Each colour's own vertex has it from itself; those that reach it back are its component.
        back = durable(colour.where("v = c").select("v"), "back")
        size, before = back.count(), -1
        while size != before:
            more = inner.join(back.withColumnRenamed("v", "b"), "b", "left_semi").select(F.col("a").alias("v"))
            back, before = durable(back.unionByName(more).distinct(), "back"), size
            size = back.count()
        inside = inner.select("a", "b").join(back.withColumnRenamed("v", "a"), "a", "left_semi").join(back.withColumnRenamed("v", "b"), "b", "left_semi")
        found = found.unionByName(inside)
        # Components are done: their vertices leave the graph.
        live = durable(live.join(back.withColumnRenamed("v", "a"), "a", "left_anti").join(back.withColumnRenamed("v", "b"), "b", "left_anti"), "edges")
    return durable(found, "found")
