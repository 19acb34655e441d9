"""Connected components of a graph held in a DataFrame, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import checkpointed, join_unique


def _attach_minimum(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest node next to or equal to a."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return join_unique(edges, smallest, "a", "n").withColumn("m", F.least("a", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _attach_minimum(both).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _attach_minimum(edges)
    lower = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(near.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, source: str, target: str, max_rounds: int = 60) -> DataFrame:
    """Maps each node of an edge list to the smallest node it can reach.

    Every round is one large-star and one small-star step (joins and
    aggregates only), cut by a checkpoint; the rounds needed grow with the
    logarithm of the longest path. Null ends and self links are left out.
    Returns node, root; nodes without links are absent; no edges give no rows.
    """
    a, b = F.greatest(source, target), F.least(source, target)
    pairs = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    current = checkpointed(pairs.select(a.alias("a"), b.alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
        seen = state
        current = checkpointed(_small_star(_large_star(current)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
