"""Connected components in Spark by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Each step keeps at most as many edges as it got, and every step is written to the shared folder. Only
    minima are gathered per node, so a node with any number of edges is no large group; skewed joins are split.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_steps):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(below, "u")
        now = cut_lineage(small.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(below.select("u", F.col("_m").alias("v")))
                          .filter("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
