"""Connected components of an edge table by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (longs, either order, repeats allowed) -> ``(node, root)`` with ``root`` the
    smallest node of its component, for every node that has an edge.

    Each round takes the smallest label among a node and its neighbours (the minimum is combined
    before the shuffle) and then follows the label of the label, so the number of rounds grows
    with the logarithm of the longest path. Both sides of each join are read from a staged table,
    so AQE can split a node with very many edges. An empty table gives an empty table.
    """
    both = edges.where("a <> b").select("a", "b")
    both = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node"))
                   .agg(F.least(F.first("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .select(F.col("a").alias("node"), "root")
                .unionByName(labels).groupBy("node").agg(F.min("root").alias("root")))
        near = stage(near, "labels")
        jumped = (near.join(near.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
                  .select("node", F.col("next").alias("root")))
        new = stage(jumped, "labels")
        changed = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
