"""Connected components of a link table, as rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kataflow.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links (a, b); label is the smallest node of the component.

    Each round takes the least label of a node's neighbours and then follows labels once (pointer jumping), so that the
    rounds grow with the logarithm of long chains and two or three do for stars. No links, no rows.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("next"))
        moved = durable(least.join(jump, "new", "left").select("node", F.least("new", F.coalesce("next", "new")).alias("label"), "old"))
        changed = moved.where("label < old").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
