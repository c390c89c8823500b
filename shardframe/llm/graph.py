"""Connected components of a graph of edges, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node of ``edges`` (``a, b`` of type long).

    Every round a node takes the smallest label among its own and its neighbours', then the label of its label. A
    round is a written table, so a lost executor costs one round at most. Rounds grow with the logarithm of the
    longest path for path-like graphs; a star takes one. Neighbours of a node are counted together by map-side
    minimums; the joins have one row per node on one side, and Spark splits their hot keys.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        least = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        of_root = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        new = written(
            least.join(of_root, "root", "left").select("node", "was", F.least("root", F.coalesce("jump", "root")).alias("root")), "labels"
        )
        labels = new.select("node", "root")
        if new.filter("was <> root").isEmpty():
            return labels
