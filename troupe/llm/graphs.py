"""Connected components of graphs that are tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troupe.runtime import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): each node takes the smallest label around it, and then that
    label's own, until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = materialize(both, "graph-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "graph-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(around, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        new = step.join(jump, "to", "left").select("node", "old", F.least("to", F.coalesce("far", "to")).alias("component"))
        new = materialize(new, "graph-labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
