"""Versions with half-open validity: which is current, which holds on a date, which overlap."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import intervals


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order, which must end in a unique tie-break."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def newest_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key: a retention limit."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def with_validity(df: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """valid_from and valid_to (start of the key's next version, null for the last)."""
    later = F.lead(start).over(Window.partitionBy(key).orderBy(start, tie))
    return df.withColumn("valid_from", F.col(start)).withColumn("valid_to", later)


def holds_on(day: Column, start: Column, end: Column) -> Column:
    """start <= day < end; a null end is open."""
    return (start <= day) & (end.isNull() | (day < end))


def _outcomes(found: DataFrame, version: str) -> DataFrame:
    outcome = F.when(F.col("matches") == 1, "resolved").when(F.col("matches") > 1, "ambiguous").otherwise("out_of_range")
    return found.withColumn("outcome", outcome).withColumn(version, F.when(F.col("matches") == 1, F.col(version)))


def _coverage() -> list[Column]:
    """first_day and last_day of a key's versions; an open end is null."""
    return [F.min("valid_from").alias("first_day"), F.when(~F.bool_or(F.col("valid_to").isNull()), F.max("valid_to")).alias("last_day")]


def as_of(versions: DataFrame, days: Sequence[date], key: str, version: str) -> DataFrame:
    """Outcome of each key and stated day: resolved (with the version), ambiguous or out_of_range; never the nearest.

    Each day is an aggregate of one grouping by key, so versions are shuffled once, partly aggregated.
    """
    told = []
    for day in days:
        hit = holds_on(F.lit(day), F.col("valid_from"), F.col("valid_to"))
        told.append(F.struct(F.lit(day).alias("day"), F.count_if(hit).alias("matches"), F.min(F.when(hit, F.col(version))).alias(version)))
    found = versions.groupBy(key).agg(*_coverage(), F.array(*told).alias("_days"))
    return _outcomes(found.select(key, "first_day", "last_day", F.inline("_days")), version)


def as_asked(versions: DataFrame, asked: DataFrame, key: str, version: str) -> DataFrame:
    """The same for each row of asked (key, day), any number of them: a sweep over each key's versions and days. version is a whole number."""
    wanted = asked.select(key, "day").distinct()
    met = intervals.at_points(versions, wanted, [key], "valid_from", "valid_to", "day", version)
    return _outcomes(met.join(versions.groupBy(key).agg(*_coverage()), key), version)


def overlaps(df: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows that begin before an earlier row of their key has ended: one sort for each key, no self-join."""
    before = Window.partitionBy(*keys).orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    open_end = F.lit("9999-12-31").cast("timestamp_ntz")
    return df.withColumn("_until", F.max(F.coalesce(F.col(end), open_end)).over(before)).filter(F.col(start) < F.col("_until")).drop("_until")


def calendar_date(c: Column) -> Column:
    """The date of a YYYY-MM-DD text; null unless it is a day of the calendar."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def validity(start: Column) -> dict[str, Column]:
    """valid_from and state of a revision: fixed with an enforcement date, else open and undetermined."""
    return {"valid_from": start, "state": F.when(start.isNotNull(), "FIXED").otherwise("UNDETERMINED")}


def first_applicable(**candidates: Column) -> tuple[Column, Column]:
    """The first candidate that is not null, and its name; none for no candidate."""
    name = F.lit("none")
    for k, c in reversed(candidates.items()):
        name = F.when(c.isNotNull(), k).otherwise(name)
    return F.coalesce(*candidates.values()), name


def snapshot_error(anchor: Column, day: Column, revision: Column, current: Column, anchors: list[str]) -> Column:
    """Why a snapshot of anchor, day and revision is invalid; null for a valid one and for none at all."""
    given = sum((c.isNotNull().cast("int") for c in (anchor, day, revision)), F.lit(0))
    return (
        F.when(given == 0, None).when(given < 3, "INCOMPLETE").when(~anchor.isin(anchors), "ANCHOR")
        .when(calendar_date(day).isNull(), "DATE").when(revision != current, "REVISION")
    )
