"""Connected components of a table of links, by distributed rounds of smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.session import durable


def label_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it can reach.

    Each round takes the smallest label among neighbours, then the label of the label, so paths
    shrink by halves.  Labels are written to the shared folder after each round; only the number
    of changes reaches the driver.  Hubs are combined before they are shuffled, and the joins
    are left to adaptive skew handling.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct(), "component-links")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "component-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = nearer.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = nearer.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label"))
        stored = durable(stepped, "component-labels")
        labels = stored.select("node", "label")
        if not stored.where("label <> was").limit(1).count():
            return labels
