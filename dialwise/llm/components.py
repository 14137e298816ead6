"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.session import frozen


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of every node, as a table of its own: adaptive execution splits a hub's
    rows in a join only where both sides come straight from their shuffles."""
    return frozen(edges.groupBy("a").agg(F.min("b").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its smallest neighbour (or itself)."""
    near = _both_ways(edges)
    least = _least(near)
    return (
        near.where("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of every node, and itself, on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge (a, b).

    Large and small stars alternate until no edge changes; each round is a table in the shared
    folder, so no lineage grows. A node with very many neighbours is pre-aggregated before the
    shuffle, and adaptive execution splits its partition in the join with the smallest neighbours.
    """
    edges = frozen(edges.where("a != b").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        edges = frozen(_small_star(_large_star(edges)), "edges")
