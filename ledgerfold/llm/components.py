"""Connected components of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (a, b), longs. Returns (node, component) for every node of a link, the component being its least node.

    Each round takes the least label among a node's neighbours, which a partial aggregate combines before the
    shuffle, and then the label of that label; rounds end when no label changes. The labels are written to the
    shared folder after each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    held = labels
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        of_label = labels.select(F.col("node").alias("new"), F.col("component").alias("jump"))
        jumped = least.join(of_label, "new", "left").select("node", F.coalesce(F.least("new", "jump"), "new").alias("component"), (F.least("new", F.coalesce("jump", "new")) != F.col("component")).alias("changed"))
        jumped = written(jumped, "labels")
        release(held)
        held, labels = jumped, jumped.drop("changed")
        if jumped.filter("changed").isEmpty():
            release(both)
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
