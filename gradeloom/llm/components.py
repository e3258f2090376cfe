"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.storage import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node (the larger ones, or the smaller ones and itself) to the least of them.

    The least is an aggregate and joined back, so a node with very many neighbours is not one task's work.
    """
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = pairs.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node) for every node with an edge; edges: a, b of one orderable type.

    Loops, repeats and both directions are fine; edges with a null end are ignored. Each round is written to
    the shared folder. No edges give no rows.
    """
    now = stored(edges.select("a", "b").filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        wide = _star(_both_ways(now), True)
        after = stored(_star(wide.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
        # Stars only: no node is both a centre and a leaf, and no leaf has two centres.
        ends = after.select(F.inline(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
                                             F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))))
        now = after
        if ends.groupBy("n").agg(F.sum("leaf").alias("s"), F.max("centre").alias("c")).filter("s > 1 or s = 1 and c = 1").isEmpty():
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
