"""Connected components by alternating large and small stars; nothing but edges moves, and rounds grow with the logarithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.text import spread_join, stored


def _stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to the centre of its star: then the stars are the components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return not roles.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    larger = F.col("b") > F.col("a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.sum(larger.cast("long")).alias("c")).where("c > 0")
    moved = spread_join(both.where(larger), stored(least, "least"), ["a"], "c")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), "least")
    moved = spread_join(down, least, ["a"], "c").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, its smallest node, of every node that an edge (a, b) with a <> b touches."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        edges = stored(_small(stored(_large(edges), "large")), "stars")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
