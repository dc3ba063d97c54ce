"""Connected components of a large graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideframe import staging


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of an edge can reach.

    ``edges`` has columns a and b of one orderable type; loops and repeats do no
    harm, and no edges give no rows. Each round takes the least label among the
    neighbours and follows the label's own label, so rounds grow with the
    logarithm of the longest path. A node with very many neighbours is a hot key
    of a plain join, which Spark splits, and of a minimum, taken map-side first.
    """
    both = staging.store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staging.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
                           "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("component").alias("there"))
        near = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("there").alias("near"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = labels.join(near, "node").join(up, "component")
        new = staging.store(step.select("node", F.least("near", "above", "component").alias("component"),
                                        F.col("component").alias("before")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> before").isEmpty():
            return labels
