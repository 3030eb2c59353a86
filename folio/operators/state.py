"""Changes to stored tables as new snapshots: insert, upsert, publish once, swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one_each(new: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """Of rows with one key the first in order; unless given, by all columns, so that the same row wins each time."""
    by = Window.partitionBy(*keys).orderBy(*(order or [F.col(c) for c in new.columns]))
    return new.withColumn("_place", F.row_number().over(by)).filter("_place = 1").drop("_place")


def inserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old and those rows of new whose key it lacks; of new rows with one key the first in order."""
    return old.unionByName(_one_each(new, keys, order).join(old.select(*keys), keys, "left_anti"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old with rows replaced by those of new with the same key, and the others of new added; of new rows with one key the first in order."""
    fresh = _one_each(new, keys, order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def set_once(df: DataFrame, column: str, value: Column, when: Column) -> DataFrame:
    """column becomes value where when holds and it is null."""
    return df.withColumn(column, F.when(when & F.col(column).isNull(), value).otherwise(F.col(column)))


def swapped(pointers: DataFrame, wanted: DataFrame) -> DataFrame:
    """pointers (id, current) moved where wanted (id, expected, next) expects what they have; outcome says so."""
    joined = pointers.join(wanted, "id", "left")
    fits = F.col("current").eqNullSafe(F.col("expected"))
    outcome = F.when(F.col("next").isNull(), "kept").when(fits, "moved").otherwise("conflict")
    return joined.select("id", F.when(outcome == "moved", F.col("next")).otherwise(F.col("current")).alias("current"), outcome.alias("outcome"))


def put(new: DataFrame, old: DataFrame) -> DataFrame:
    """revision, checksum and outcome of putting new (revision, checksum) into a store that has old (revision, there): stored, kept or conflict."""
    outcome = F.when(F.col("there").isNull(), "stored").when(F.col("there") == F.col("checksum"), "kept").otherwise("conflict")
    return new.join(old, "revision", "left").select("revision", "checksum", outcome.alias("outcome"))
