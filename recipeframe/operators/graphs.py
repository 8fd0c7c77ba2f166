"""Cliques of an undirected graph, from its edges.

``edges`` is ``src, dst`` with both directions of each link; loops and repeats
are ignored. A set of nodes comes to the driver only as a clique's members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeframe.functions.shared import truncate


def clean_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def is_clique(edges: DataFrame, nodes: list) -> DataFrame:
    """``is_clique``: whether all of ``nodes`` are linked to each other; a repeated or unknown node is no clique's."""
    n = len(nodes)
    inside = clean_edges(edges).filter(F.col("src").isin(nodes) & F.col("dst").isin(nodes))
    found = inside.agg((F.count("*") == n * (n - 1)).alias("is_clique"))
    return found if len(set(nodes)) == n else found.select(F.lit(False).alias("is_clique"))


def valid_additions(edges: DataFrame, members: list) -> DataFrame:
    """``node``: those that are linked to every member and are none of them."""
    by = clean_edges(edges).filter(F.col("src").isin(members) & ~F.col("dst").isin(members)).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return by.filter(F.col("n") == len(set(members))).select("node")


def greedy_clique(edges: DataFrame, start=None) -> DataFrame:
    """``place, node``: from a node (that of the largest degree) on, the valid addition of the largest degree is taken until there is none; ties go to the smallest node.

    A round keeps, of the nodes that could be added, those linked to the new
    member; they only get fewer.
    """
    spark, links = edges.sparkSession, truncate(clean_edges(edges))
    degrees = truncate(links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    order = [F.desc("degree"), F.asc("node")]
    kind = edges.schema["src"].dataType.simpleString()
    first = degrees.orderBy(*order).first() if start is None else degrees.filter(F.col("node") == start).first()
    if first is None:
        return spark.createDataFrame([], f"place int, node {kind}")
    members, left = [first["node"]], degrees
    while True:
        near = links.filter(F.col("src") == members[-1]).select(F.col("dst").alias("node"))
        left = truncate(left.join(near, "node", "left_semi"))
        best = left.orderBy(*order).first()
        if best is None:
            return spark.createDataFrame(list(enumerate(members, 1)), f"place int, node {kind}")
        members.append(best["node"])
