"""Connected components of a graph given as edges, by distributed label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiray.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the least node of each component; nodes are of any ordered type.

    Each round takes the least label among a node's neighbours, then the label of that label, so that
    paths shorten by halves; it ends when no label changes. Every round is written to the shared folder.
    Neighbours of a crowded node are combined before the shuffle; joins on it are split by adaptive execution."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("root").alias("_far"))
        after = cut_lineage(step.join(jump, "_new", "left").select("node", F.least("_new", F.coalesce("_far", "_new")).alias("root"), "_old"))
        changed = after.filter(F.col("root") != F.col("_old")).limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels
