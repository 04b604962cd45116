"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import store


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for links ``a, b`` between different nodes.

    Every round takes the smallest label among neighbours and then the label of that label, so chains halve; each
    round's labels are written to the shared folder, which keeps lineage short.
    """
    both = store(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), "was")
        after = store(jumped, "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
