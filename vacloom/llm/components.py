"""Connected components of a graph given as pairs of node numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacloom.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b): the smallest node number that it can reach.

    Each round takes the least label among the neighbours and then the label of that label, so chains
    shorten by half. Labels stay in the cluster; only whether one changed reaches the driver.
    """
    both = durable(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(seen.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = durable(nearer.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
