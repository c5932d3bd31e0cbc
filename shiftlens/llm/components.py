"""Connected components of a link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round takes the smallest label among a node and its neighbours and then
    follows the label's own label. Minima are formed before the shuffle, and a node
    with very many links is only ever a join key, so no task gathers its neighbours.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")
    ), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a")
        near = near.agg(F.min("component").alias("m")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("to"), "component")
        lower = materialize(lower, "lower")
        jumped = lower.select(F.col("node").alias("to"), F.col("to").alias("next"))
        labels = materialize(
            lower.join(jumped, "to").select("node", F.least("to", "next").alias("component"), F.col("component").alias("old")),
            "labels",
        )
        if labels.filter("component != old").isEmpty():
            return labels.select("node", "component")
