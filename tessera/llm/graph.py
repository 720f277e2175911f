"""Connected components over links, by smallest labels and pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node and label, the smallest node that is reachable, for every node that has a link.

    Each round takes the smallest label among neighbours, summed up on the map side, then the label of that label, so
    paths shrink by half or more. Labels are written to the shared folder after each round.
    """
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.where("a != b").distinct(), "cc-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialise(stepped.join(up, "label").select("node", "before", F.least("label", "up").alias("label")), "cc-labels")
        labels = jumped.select("node", "label")
        if jumped.where("before != label").isEmpty():
            return labels


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels: node, label (as components gives them); links: a, b, between labels or nodes without a label. The labels when links are added."""
    links = materialise(links.select("a", "b"), "cc-joints")
    if links.isEmpty():
        return labels
    up = components(links)
    over = labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    new = up.join(labels.select("node"), "node", "left_anti")
    return materialise(over.unionByName(new.select("node", "label")), "cc-labels")
