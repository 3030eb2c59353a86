"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import written


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each node's neighbours and the node; partially aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node that it reaches) of the nodes of edges (u long, v long).

    Each round halves the longest way at least about, so rounds grow with the logarithm of the largest
    component's diameter. A node with any number of neighbours is only aggregated and joined, never collected.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        parents = now.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n"))
        inner = now.select(F.col("v").alias("u")).join(parents.select("u"), "u", "left_semi")
        if not parents.filter("n > 1").head(1) and not inner.head(1):  # stars
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = large.join(_least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
