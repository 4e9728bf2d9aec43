"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Edges
stay distributed; each round is a group-minimum (combined before the shuffle)
and a join, which adaptive execution splits where a hub is hot: the join's key
is a result of the group-minimum and not its key, so both sides are dealt anew
and neither is bound to the minimum's partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.max("u").alias("n"), F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
    up = both.where("v > u")
    return up.join(least, up.u == least.n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.max("u").alias("n"), F.min("v").alias("m")).select("n", "m")
    moved = down.join(least, down.u == least.n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("n").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (u, v); component is the least node reachable.

    Self loops and rows with a null end are ignored. Edgeless input gives no rows.
    """
    now = scratch.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        new = scratch.cut(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct())
        scratch.drop(now)
        now = new
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
