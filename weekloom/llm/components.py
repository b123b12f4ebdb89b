"""Connected components of an edge table, by smallest reachable node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import cut_lineage
from weekloom.llm.common import let_go


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (u, v); label: the smallest node of its component.

    Each round takes the smallest label among the neighbours, then the label of that label, so the
    rounds grow with the logarithm of a component's width. Rounds end in reliable checkpoints.
    """
    both = cut_lineage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = cut_lineage(lower)
        onward = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        jumped = lower.join(onward, "label").select("node", "old", F.least("label", "far").alias("label"))
        jumped = cut_lineage(jumped)
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
        del near, lower, onward, jumped
        let_go(edges.sparkSession)
