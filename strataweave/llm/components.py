"""Connected components of an edge table, as a Spark job per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import release, stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reached) of every node in ``edges(a, b)``.

    Each round takes the smallest label among neighbours, then the label of the label, so paths halve. Labels live in staged
    tables; only the number of changed labels comes to the driver. Nulls must not occur; repeated edges and loops do no harm.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = stage(step.join(jump, "next", "left").select("node", "old", F.least("next", "far").alias("component")))
        changed = moved.filter("component < old").limit(1).count()
        release(labels)
        labels = moved.select("node", "component")
        labels.staged_at = moved.staged_at
        if not changed:
            release(both)
            return labels
