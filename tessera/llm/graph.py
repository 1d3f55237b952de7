"""Connected components of a graph of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``a, b``.

    Labels are the smallest label of the neighbours, then the label of that label, until nothing changes; each
    round at least squares the distance that a label has travelled along labelled nodes. Hub nodes are only ever
    aggregated (with partial sums) and joined, never gathered. Without edges, no rows.
    """
    both = edges.where("a <> b").select("a", "b").distinct()
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = label.join(near, "node").select("node", "component", F.least("component", "near").alias("c"))
        up = label.select(F.col("node").alias("c"), F.col("component").alias("jump"))
        new = stored(least.join(up, "c").select("node", F.col("component").alias("old"), F.least("c", "jump").alias("component")), "labels")
        changed = new.where(F.col("old") != F.col("component")).limit(1).count()
        label = new.select("node", "component")
        if not changed:
            return label
