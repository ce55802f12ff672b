"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.llm.common import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours; partial sums absorb a node with many edges."""
    return edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: a node with a smaller neighbour has no other."""
    return _both(edges).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("m < u and n > 1").isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of ``edges(a, b)``; component is its smallest node.

    Each round attaches the larger neighbours of a node to its smallest one (large star), then
    the smaller ones (small star); a logarithmic number of rounds leaves one star per component.
    Every step is a join and a grouping; the edges never leave the executors, and each half
    round is a table in the shared folder, removed when the next one is written. Null ends and loops are ignored.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        both = _both(edges)
        large = materialize(both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = _least_neighbour(large)
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(edges, large)
        edges = small
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
