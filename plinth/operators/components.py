"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step moves every edge towards the smallest neighbour, and the tables hold at
most the edges that came in. A vertex with very many neighbours is reduced by a
map-side minimum, and the join that follows is one whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.tables import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges`` that is not its component's smallest.

    Loops and null ends are ignored; repeated edges count once; an empty table gives
    no rows. Raises if ``max_rounds`` do not suffice, rather than return part of a result.
    """
    start = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    current = written(start.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct(), "edges")
    mark = _mark(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        current = written(_small_star(_large_star(current)), "edges")
        new = _mark(current)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
