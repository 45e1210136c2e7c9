"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from aforo.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the least node reachable.

    Each round takes the least label among a node and its neighbours, then
    follows that label one step, so paths shrink fast. A round's labels are
    stored, which cuts lineage; the number of changes is observed on the way, so that
    no job of its own counts them, and is all that the driver sees. A
    label may be shared by a third of all nodes: that join has two stored sides
    and can be split. No edges: no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "graph-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "graph-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        own = labels.withColumnRenamed("root", "_old").join(near, "node").withColumn("_at", F.least("_old", "_near"))
        further = labels.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
        moved = own.join(further, "_at", "left").select("node", F.least("_at", "_next").alias("root"), "_old")
        changes = Observation()
        labels = stored(moved.observe(changes, F.count_if(F.col("root") != F.col("_old")).alias("n")).select("node", "root"), "graph-labels")
        if not changes.get.get("n"):
            return labels
