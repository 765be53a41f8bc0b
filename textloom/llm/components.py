"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    sides = _sides(edges)
    least = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return sides.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the least of them."""
    down = edges.where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Return ``(node, root)`` for every node of ``edges(a, b)``; root is the least node of its component.

    Alternating large and small stars (Kiveris et al., 2014): a logarithmic number of rounds, each a few
    shuffles of as many rows as there are edges at most, written to the shared folder. A hub's edges are
    aggregated before they move and joined with a join that Spark can split, so no task gathers a whole
    component. Loops and repeated edges are harmless; nodes without an edge do not appear; an empty input
    gives an empty result. Nulls are dropped, as a null end links nothing.
    """
    now = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        after = materialise(_small_star(_large_star(now)))
        drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hashes of the edges: equal when a round changed nothing."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
