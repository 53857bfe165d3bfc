"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def merge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) of all ``nodes`` (id): the least id that ``edges`` (a, b) lead to.

    Every round hangs each node under its least neighbour, shortens the paths of that
    forest to their roots, and keeps the edges between different roots: their number of
    nodes at least halves, so rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder. No component is ever gathered.
    """
    labels = nodes.select("id", F.col("id").alias("root"))
    edges = edges.select("a", "b").where("a <> b").distinct()
    while not (edges := written(edges, "edges")).isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up")), "parents")
        while True:
            over = parents.select(F.col("id").alias("up"), F.col("up").alias("next"))
            shorter = written(parents.join(over, "up").select("id", F.col("next").alias("new"), (F.col("next") != F.col("up")).alias("moved")), "parents")
            parents = shorter.select("id", F.col("new").alias("up"))
            if shorter.where("moved").isEmpty():
                break
        top = parents.select(F.col("id").alias("root"), F.col("up").alias("top"))
        labels = written(labels.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "labels")
        for c in ("a", "b"):
            edges = edges.join(parents.select(F.col("id").alias(c), F.col("up").alias(f"top_{c}")), c)
        edges = edges.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")).where("a <> b").distinct()
    return written(labels, "labels")
