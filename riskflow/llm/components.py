"""Connected components of links between numbered nodes, as joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def components(links: DataFrame) -> DataFrame:
    """``key`` and the smallest key of its component, ``label``, for all nodes of ``links`` (a, b).

    Every node takes the smallest label among its neighbours, then the label of its label,
    until nothing moves. Each round is written; no node or link reaches the driver.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(
        edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b")).select("key", F.least("key", "b").alias("label")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.withColumnRenamed("key", "b"), "b")
            .groupBy(F.col("a").alias("key"))
            .agg(F.min("label").alias("near"))
        )
        lower = stored(
            labels.join(near, "key").select("key", F.col("label").alias("before"), F.least("label", "near").alias("label")), "labels"
        )
        heads = lower.select(F.col("key").alias("label"), F.col("label").alias("head"))
        moved = stored(
            lower.join(heads, "label").select("key", "before", F.least("label", "head").alias("label")), "labels"
        )
        labels = moved.select("key", "label")
        if moved.filter("label <> before").isEmpty():
            return labels
