"""Connected components by contraction.

In every round a node points to the neighbour, itself included, with the smallest hash of that round; nodes that point
to the same one become one node, and only edges between different ones stay. Random hashes shrink chains as fast as
stars, so the rounds grow with the logarithm of the number of nodes. Every round is written down; the driver sees one
boolean per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for each end of the edges ``a, b``."""
    first = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    level, maps, round_no = stage(first, "edges"), [], 0
    while not level.isEmpty():
        round_no += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_no), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = level.select("a", rank("b").alias("to"), rank("a").alias("own")).unionByName(
            level.select(F.col("b").alias("a"), rank("a").alias("to"), rank("b").alias("own"))
        )
        best = both.groupBy("a").agg(F.least(F.min("to"), F.min("own"))["id"].alias("to"))
        points = stage(best, "points")
        left = points.select("a", F.col("to").alias("x"))
        right = points.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = level.join(left, "a").join(right, "b").where("x <> y")
        level = stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        maps.append(points)
    if not maps:
        return first.select(F.col("a").alias("id"), F.col("a").alias("component"))
    # From the last round back: where a node went, and where that went.
    roots = maps[-1].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for points in reversed(maps[:-1]):
        later = roots.select(F.col("id").alias("to"), "root")
        roots = points.join(later, "to", "left").select(F.col("a").alias("id"), F.coalesce("root", "to").alias("root"))
    roots = stage(roots, "roots")
    smallest = roots.groupBy("root").agg(F.min("id").alias("component"))
    return stage(roots.join(smallest, "root").select("id", "component"), "components")
