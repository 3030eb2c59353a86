"""Points in intervals and intervals that overlap, by one sorted sweep of each key: starts, ends and questions in one order with running counts.

A key with any number of intervals and questions costs a sort, not their product, and a task holds one row of it at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_EXACT = "decimal(38,0)"


def at_points(intervals: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, point: str, version: str) -> DataFrame:
    """Each row of points (keys, point) with matches, how many of its key's intervals hold it (start <= point < end; a null end is open), and version of the one if there is one.

    version is a whole number. What has begun less what has ended is what holds; of one interval, so is the sum of the versions.
    """
    none = F.lit(None).cast(_EXACT)
    held = intervals.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) < F.col(end))))
    number = F.col(version).cast(_EXACT)
    begun = held.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_n"), number.alias("_v"))
    ended = held.filter(F.col(end).isNotNull()).select(*keys, F.col(end).alias("_at"), F.lit(0).alias("_kind"), F.lit(-1).alias("_n"), (-number).cast(_EXACT).alias("_v"))
    asked = points.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_n"), none.alias("_v"))
    so_far = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = begun.unionByName(ended).unionByName(asked).withColumn("matches", F.sum("_n").over(so_far)).withColumn("_v", F.sum("_v").over(so_far))
    one = F.when(F.col("matches") == 1, F.col("_v").cast("long"))
    return swept.filter("_kind = 1").select(*keys, F.col("_at").alias(point), "matches", one.alias(version))


def overlap_counts(spans: DataFrame, others: DataFrame, keys: list[str], span: str, start: str, end: str, name: str = "n") -> DataFrame:
    """keys, span and name: how many of others (keys, start, end) of its key overlap each of spans (keys, span, which tells them apart, start, end).

    That is those that start before its end less those that end by its start. One that ends before it starts is none.
    """
    fine = F.col(start) <= F.col(end)

    def events(rows: DataFrame, at: str, kind: int, sign: int, column: str) -> DataFrame:
        """kind, at one place: ends, then questions, then starts."""
        return rows.filter(fine).select(*keys, F.col(column).alias(span) if column else F.lit(None).cast(spans.schema[span].dataType).alias(span), F.col(at).alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"))

    every = events(others, end, 0, 0, "").unionByName(events(others, start, 2, 0, "")).unionByName(events(spans, end, 1, 1, span)).unionByName(events(spans, start, 1, -1, span))
    so_far = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    begun, ended = (F.count_if(F.col("_kind") == k).over(so_far) for k in (2, 0))
    asked = every.withColumn("_n", F.when(F.col("_sign") == 1, begun).when(F.col("_sign") == -1, -ended)).filter("_kind = 1")
    return asked.groupBy(*keys, span).agg(F.sum("_n").alias(name))
