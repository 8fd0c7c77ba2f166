"""Connected components by alternating star contractions.

Large-star links every larger neighbour of a node to the smallest node it can
see; small-star links the smaller neighbours to each other's minimum. Both are
a ``min`` aggregate (combined before its shuffle) and an equi join, so no node
list is ever gathered in one row, and the number of rounds grows with the
logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.shared import truncate


def connected_components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node of its component.

    Returns ``node, label`` for nodes that have an edge to another node. Self
    loops, repeated edges, and either direction are allowed; null ends are
    ignored. An empty edge table gives an empty result. Rounds go on until nothing
    moves; if ``most_rounds`` is given and isn't enough, that is an error, never a
    result with components that are only half merged.
    """
    links = edges.filter("a is not null and b is not null and a <> b")
    links = truncate(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, rounds = None, 0
    while True:
        if most_rounds is not None and rounds >= most_rounds:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
        rounds += 1
        links = truncate(_small_star(_large_star(links)))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = nodes.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    return nodes.unionByName(roots)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # v > u, linked to the minimum of u's neighbourhood
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
