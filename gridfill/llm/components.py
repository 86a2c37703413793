"""Connected components of an edge table, by contraction: every node takes its smallest neighbour as parent, edges move to the
parents, and edges inside a node go. The graph shrinks by a constant factor a round; no node's neighbours are collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfill.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all nodes in `edges` (a, b); label is one node of the component."""
    edges = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = materialize(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")))
        if labels is None:
            labels = parents.select(F.col("a").alias("id"), F.col("p").alias("label"))
        else:
            moved = parents.withColumnsRenamed({"a": "label"})
            labels = materialize(labels.join(moved, "label", "left").select("id", F.coalesce("p", "label").alias("label")))
        ends = [parents.select(F.col("a").alias(c), F.col("p").alias(f"p{c}")) for c in ("a", "b")]
        edges = edges.join(ends[0], "a").join(ends[1], "b").filter(F.col("pa") != F.col("pb"))
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if edges.isEmpty():
            return labels
