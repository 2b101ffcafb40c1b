"""Connected components by smallest label, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspan.llm.common import drop_staged, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then that label's own label, so paths
    shorten by more than half a round. Labels are written to the shared folder after each round. Loops and repeated
    edges do no harm; no edges, no rows.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b"), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hop = near.join(labels, F.col("a") == F.col("node")).select(F.col("a").alias("node"), F.least("near", "component").alias("hop"), F.col("component").alias("was"))
        onward = labels.select(F.col("node").alias("at"), F.col("component").alias("onward"))
        new = stage(hop.join(onward, F.col("hop") == F.col("at")).select("node", F.least("hop", "onward").alias("component"), "was"), "labels")
        moved = new.filter("component <> was").limit(1).count()
        drop_staged(labels)
        labels = new
        if not moved:
            drop_staged(both)
            return labels.select("node", "component")
