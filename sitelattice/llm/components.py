"""Connected components by alternating stars, with DataFrame operations only.

Every round joins each node with the least node it can see: large-star hands the larger neighbours of
a node to its least neighbour, small-star the smaller ones. Minima are pre-aggregated before the
shuffle and joined back, so a node with very many neighbours is a skewed join key, which Spark
splits, and never one group in memory. Each round is written to the shared folder
and the one before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.llm.common import discard, materialise


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m: the least of u and all its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(low, "u").withColumn("m", F.least("u", "low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _least(down)
    return (found.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionAll(found.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .where(F.col("a") != F.col("b")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Does every node point at one root, and no root at another node?"""
    if edges.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; root is the least node of its component.
    Edges with a null end or equal ends are no edges."""
    ends = edges.where("a is not null and b is not null and a <> b")
    now = materialise(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        before, now = now, materialise(_small_star(_large_star(now)))
        discard(before)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
