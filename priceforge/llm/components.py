"""Connected components by spreading the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priceforge.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; the root is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label. Every round is stored, so a lost executor costs one round. Minima are combined before
    each shuffle, so a node with very many links is no hot key.
    """
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(ends.union(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = materialize(
        both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label"))
    )
    while True:
        beside = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("near"))
        )
        spread = materialize(
            labels.join(beside, "node").select(
                "node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")
            )
        )
        if spread.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "root")
        above = spread.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = materialize(spread.join(above, "label").select("node", F.least("label", "up").alias("label")))
