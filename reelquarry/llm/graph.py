"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import folders, hot_keys, keep, settle, spread_join


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs to (node, label): the smallest node that each node reaches. Nodes without links have no row.

    Each round takes the smallest label among a node's neighbours and then the label of its label, so the
    rounds follow the logarithm of the longest path. Rounds are kept in the shared folder, each until the next one is written.
    A node with many neighbours, and a label of many nodes, is dealt over several tasks. Loops and repeated
    links do no harm; an empty table gives an empty table.
    """
    edges = keep(links.select("a", "b").union(links.select("b", "a")).where(F.col("a") != F.col("b")).distinct(), "edges")
    centres = hot_keys(edges.groupBy("b").agg(F.count(F.lit(1)).alias("m")), "b")
    mark = folders()
    start = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = settle(start.select("node", F.least("node", "m").alias("label")), "labels", mark)
    while True:
        near = (
            spread_join(edges, labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b", centres)
            .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        )
        step = keep(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("step")), "step")
        shared = hot_keys(step.groupBy("step").agg(F.count(F.lit(1)).alias("m")), "step")
        jump = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        now = spread_join(step, jump, "step", shared, "left").select("node", F.least("step", "far").alias("label"), "label").toDF("node", "label", "was")
        now = settle(now, "labels", mark)
        changed = now.where(F.col("label") != F.col("was")).limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            return labels
