"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the smallest node of its component.

    Each round every node takes the smallest label among its neighbours and then the label
    of that label, so long chains shrink by powers. Labels are written after each round;
    only their number of changes comes to the driver. Neighbour labels are reduced by
    ``min`` before the shuffle, so a node with very many edges stays one row per task.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Every label is a node, so its own label can be looked up.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = saved(best.join(jump, "label").select("node", "old", F.least("label", "jump").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
