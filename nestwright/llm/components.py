"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.common import beside_group, stash, unstash


#: Parts into which the neighbours of one node are dealt.
PARTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least of u and its neighbours. A node may have much of the graph beside it, so its edges
    are dealt to parts."""
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    return beside_group(dealt, ["u"], "part", {"m": (F.least(F.min("u"), F.min("v")), F.min("m"))}, "m is not null").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    moved = _with_least(edges)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(moved.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node that an edge (u, v) of longs names; comp is the least node it reaches.

    Every step is a shuffle by node with sums made before it; nothing but counts reaches the driver. The
    number of steps grows with the logarithm of the longest chain. Each step's edges are written to the
    shared folder, so that a lost executor costs one step at most. No edges: no rows."""
    state = stash(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        count = state.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if tuple(count) == seen or not count.n:
            break
        seen = tuple(count)
        following = stash(_small_star(_large_star(state)), "edges")
        unstash(state)
        state = following
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))
