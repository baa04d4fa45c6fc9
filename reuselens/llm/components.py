"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Alternating stars: a large star links the larger neighbours of each node to the smallest node it
    sees, a small star the smaller ones; the rounds grow with the logarithm of the graph. Each round
    is written to the shared folder, so lineage stays short. A node's neighbours are never gathered:
    the minimum is an aggregate, combined before the shuffle, and is joined back to the links, where
    a node with very many links can be split.
    """
    spark = links.sparkSession
    at = scratch(spark)
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialise(edges, f"{at}/0")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = None
    for k in range(1, max_rounds + 1):
        # Large star: larger neighbours of a node go to the smallest of the node and its neighbours.
        both = edges.union(edges.select("b", "a"))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{at}/{k}-large-least")
        large = materialise(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{at}/{k}-large")
        # Small star: smaller neighbours of a node, and the node itself, go to the smallest of them.
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{at}/{k}-small-least")
        joined = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(joined.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{at}/{k}")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes.node == roots.a, "left").select("node", F.coalesce("root", "node").alias("root"))
