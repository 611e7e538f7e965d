"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.tables import forget, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest one around that node."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is hung on the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src")
    return moved.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", F.col("low").alias("dst")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (src, dst: any ordered type); component is the smallest node reachable.

    Self loops and null ends are ignored, repeated edges count once. Each round is written to the shared folder; the rounds grow with the
    logarithm of the number of nodes, whatever the diameter. An empty table gives an empty result.
    """
    now = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if not seen.n or (seen.n, seen.h) == mark:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst").distinct())
        mark = (seen.n, seen.h)
        step = _small_star(_large_star(now).distinct()).filter("src <> dst").distinct()
        after = written(step, "edges")
        forget(now)
        now = after
