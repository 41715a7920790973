"""Connected components of a graph that only exists as a table of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that can be reached.

    ``edges`` has two long columns a and b; nodes without an edge are not
    returned.  Every round, each node hands the grandparent label of its
    neighbours to itself and to its own parent and jumps to its grandparent
    (the FastSV rules), so that the rounds grow with the logarithm of the
    longest path.  A hub is one row per task and label after the partial
    minimum; only counts reach the driver.  Rounds are written tables.
    """
    both = staged(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("f")).withColumnRenamed("a", "node"))
    while True:
        parents = labels.select(F.col("node").alias("f"), F.col("f").alias("g"))
        known = labels.join(parents, "f").select("node", "f", "g")
        heard = (
            both.join(known.select(F.col("node").alias("b"), "g"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("g").alias("m"))
            .join(known, "node")
        )
        news = [
            heard.select("node", F.least("f", "g", "m").alias("f")),
            heard.select(F.col("f").alias("node"), F.col("m").alias("f")),
        ]
        new = staged(reduce(DataFrame.unionByName, news).groupBy("node").agg(F.min("f").alias("f")))
        moved = new.join(labels, ["node", "f"], "left_anti").limit(1).count()
        drop_staged(labels)
        labels = new
        if not moved:
            drop_staged(both)
            return labels.withColumnRenamed("f", "root")
