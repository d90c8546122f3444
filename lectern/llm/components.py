"""Connected components of a link table by smallest id, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links(a, b)``; component is the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label
    of that label, so paths shorten by half; rounds grow with the logarithm of
    the longest path. Labels are written every round, nothing is collected.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a <> b").distinct(), "links")
    label = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select(
        "id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = edges.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("component").alias("m"))
        lower = label.join(near, "id").select("id", F.col("component").alias("old"),
                                              F.least("component", "m").alias("component"))
        up = lower.select(F.col("id").alias("component"), F.col("component").alias("above"))
        step = stored(lower.join(up, "component", "left").select(
            "id", "old", F.coalesce("above", "component").alias("component")), "labels")
        label = step.select("id", "component")
        if step.where("old <> component").isEmpty():
            return label
