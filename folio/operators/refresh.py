"""Refresh of many documents' revisions in one job: errors are rows, and one document's failure leaves the others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = {"check": "checked", "dry-run": "planned", "apply": "activated"}


def refreshed(before: DataFrame, after: DataFrame, *, mode: str = "apply", most_change: float = 0.2) -> DataFrame:
    """One row for each document of two snapshots (doc, key, content): counts, problem and outcome.

    problem: EMPTY, DUPLICATE_KEY or NODE_COUNT (the count moves by more than most_change), then the outcome is
    failed. Else unchanged, held (nodes were removed) or, by mode, checked, planned or activated.
    """
    a = before.select("doc", "key", "content", F.lit(True).alias("old"))
    both = a.unionByName(after.select("doc", "key", "content", F.lit(False).alias("old")))
    keys = both.groupBy("doc", "key").agg(
        F.count_if("old").alias("a"), F.count_if(~F.col("old")).alias("b"),
        F.max(F.when(F.col("old"), F.col("content"))).alias("content_a"), F.max(F.when(~F.col("old"), F.col("content"))).alias("content_b"),
    )
    docs = keys.groupBy("doc").agg(
        F.sum("a").alias("nodes_before"), F.sum("b").alias("nodes_after"), F.count_if(F.col("b") > 1).alias("repeated"),
        F.count_if(F.col("a") == 0).alias("added"), F.count_if(F.col("b") == 0).alias("removed"),
        F.count_if((F.col("a") > 0) & (F.col("b") > 0) & ~F.col("content_a").eqNullSafe(F.col("content_b"))).alias("modified"),
    )
    moved = (F.col("nodes_before") > 0) & (F.abs(F.col("nodes_after") - F.col("nodes_before")) > most_change * F.col("nodes_before"))
    problem = F.when(F.col("nodes_after") == 0, "EMPTY").when(F.col("repeated") > 0, "DUPLICATE_KEY").when(moved, "NODE_COUNT")
    same = (F.col("added") == 0) & (F.col("removed") == 0) & (F.col("modified") == 0)
    outcome = F.when(F.col("problem").isNotNull(), "failed").when(same, "unchanged").when(F.col("removed") > 0, "held").otherwise(OUTCOMES[mode])
    return docs.withColumn("problem", problem).withColumn("outcome", outcome)
