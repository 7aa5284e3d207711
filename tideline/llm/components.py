"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.llm.frames import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``a, b`` rows; the label is the smallest node that links reach.

    Labels take the smallest label around them and then jump to that label's own label, until a round changes none. Both steps
    are joins and sums with partial aggregation, so a node with very many edges is no single task; each round is a written table.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_near"))
        near = labels.join(around, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_hop"))
        jump = labels.select(F.col("node").alias("_hop"), F.col("label").alias("_far"))
        new = staged(near.join(jump, "_hop").select("node", F.least("_hop", "_far").alias("label"), (F.least("_hop", "_far") < F.col("_old")).alias("_moved")), "cc-labels")
        labels = new.select("node", "label")
        if not new.filter("_moved").limit(1).count():
            return labels
