"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martflow.llm.common import staged


def fewer(edges: DataFrame, label: str = "ties") -> DataFrame:
    """Edges that connect the same nodes, about one for each node.

    Every node keeps the edge to its smallest neighbour in ``_b``, and its other
    neighbours are tied to that one as well, which many nodes have in common.  For edges
    in which a node stands in ``_a`` a bounded number of times."""
    smallest = F.min("_b").over(Window.partitionBy("_a"))
    ties = staged(edges.select("_a", "_b").distinct().withColumn("_m", smallest), label)
    near = ties.select("_a", F.col("_m").alias("_b"))
    far = ties.select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    return near.union(far).where("_a != _b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(_node, _root)`` for every node of ``edges`` (``_a``, ``_b``: whole numbers):
    the smallest node that it is connected with.

    Each round takes the smallest label among a node and its neighbours, then that
    label's own label.  Labels are written out each round, so no lineage builds up; both
    sides of every join are exchanged, so hot nodes are split, and minima are combined
    map-side.  Rounds end when no label changes."""
    both = staged(
        edges.select("_a", "_b").union(edges.select(F.col("_b"), F.col("_a"))).where("_a != _b").distinct(), label
    )
    labels = staged(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_b"), F.col("_node")).alias("_root")), label)
    while True:
        reached = (
            both.join(labels, F.col("_b") == F.col("_node"))
            .groupBy(F.col("_a").alias("_node"))
            .agg(F.min("_root").alias("_near"))
        )
        lower = labels.join(reached, "_node").select("_node", F.col("_root").alias("_old"), F.least("_root", "_near").alias("_to"))
        jump = labels.select(F.col("_node").alias("_to"), F.col("_root").alias("_far"))
        new = staged(lower.join(jump, "_to").select("_node", "_old", F.least("_to", "_far").alias("_root")), label)
        labels = new.select("_node", "_root")
        if new.where("_root != _old").isEmpty():
            return labels
