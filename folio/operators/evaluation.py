"""Retrieval quality: recall, reciprocal rank and coverage, by group and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 10


def per_case(cases: DataFrame, results: DataFrame, *, top: int = TOP) -> DataFrame:
    """case, category, targets, hits, first (rank of the first hit) of each case.

    cases: case, category, target (a row for each); results: case, item, rank. Repeated results do not add hits.
    """
    best = results.filter(F.col("rank") <= top).groupBy("case", F.col("item").alias("target")).agg(F.min("rank").alias("rank"))
    found = cases.select("case", "category", "target").distinct().join(best, ["case", "target"], "left")
    return found.groupBy("case", "category").agg(F.count(F.lit(1)).alias("targets"), F.count("rank").alias("hits"), F.min("rank").alias("first"))


def summary(measured: DataFrame) -> DataFrame:
    """Micro recall, mean reciprocal rank and rate of complete cases for each category and for all (category null)."""
    rows = measured.groupingSets([["category"], []], "category").agg(
        F.count(F.lit(1)).alias("cases"), (F.sum("hits") / F.sum("targets")).alias("recall"),
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg((F.col("hits") == F.col("targets")).cast("double")).alias("complete"),
    )
    return rows


def set_coverage(expected: Column, observed: Column) -> Column:
    """Share of expected that was observed: 1 when nothing is expected, null when nothing was recorded."""
    want = F.array_distinct(expected)
    return F.when(observed.isNull(), None).when(F.size(want) == 0, 1.0).otherwise(F.size(F.array_intersect(want, observed)) / F.size(want))


def ordered_coverage(expected: Column, observed: Column) -> Column:
    """Share of expected that occurs in observed in this order, taken greedily from the front."""
    seen = F.aggregate(observed, F.lit(0), lambda i, x: F.when(F.get(expected, i) == x, i + 1).otherwise(i))
    return F.when(observed.isNull(), None).when(F.size(expected) == 0, 1.0).otherwise(seen / F.size(expected))
