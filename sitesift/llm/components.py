"""Connected components of an edge table by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialise


def _stars(edges: DataFrame, total: int, small: bool) -> DataFrame:
    """edges u > v, `total` of them. A hub's neighbours are joined to its minimum, not gathered, and those of a hot hub without a shuffle."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times"))
    joined = join_hot(both, least, "u", "times", total if small else 2 * total)
    if small:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v")))
    else:
        made = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        # a node's own edge to its minimum is made from the other side, unless the node is that minimum
    out = materialise(made.distinct())
    discard(least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, label: each node of an edge and the smallest node that it reaches. A graph that is not done after `rounds` is an error."""
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    mark = None
    for _ in range(rounds):
        found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.count_distinct("u")).first())
        # every node has one edge, to its minimum, once the steps change nothing
        if found[0] == 0 or found == mark:
            break
        mark = found
        large = _stars(now, found[0], small=False)
        after = _stars(large, large.count(), small=True)
        discard(now, large)
        now = after
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
