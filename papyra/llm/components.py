"""Connected components of a link table by Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``: the smallest node it can reach.

    Each round gives a node the smallest label among its neighbours and then follows that
    label one step further, so rounds grow with the logarithm of the longest path. Labels are
    written to the shared folder in each round, which cuts the lineage. The hot side of a
    join is the edge table, which Spark can split; labels are one row per node. Without links
    the result is empty.
    """
    edges = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b"), "edges"
    )
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        step = materialize(step, "step")
        ahead = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        step = materialize(step.join(ahead, "mid").select("node", "old", F.least("mid", "far").alias("root")), "labels")
        labels = step.select("node", "root")
        if step.filter("old <> root").isEmpty():
            return labels
