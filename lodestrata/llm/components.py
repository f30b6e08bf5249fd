"""Connected components by alternating star contraction, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each larger neighbour of u to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins u and its smaller neighbours to the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, root) for every node with a link to a smaller one; root is the least node of its component.

    ``edges`` has columns a and b. Rounds grow with the logarithm of the number of nodes; each one is
    written to the shared folder, so no lineage builds up.
    """
    own = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own = settle(own, "edges")
    shape = _shape(own)
    for _ in range(most_rounds):
        if shape[0] == 0:
            break
        own = settle(_small_star(_large_star(own)), "edges")
        before, shape = shape, _shape(own)
        if before == shape and _is_stars(own):
            break
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    return own.select("u", F.col("v").alias("root"))


def _shape(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _is_stars(edges: DataFrame) -> bool:
    """Whether no root is itself joined to another node, nor a node to two roots."""
    twice = edges.groupBy("u").count().filter("count > 1")
    return not (twice.limit(1).count() or edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count())
