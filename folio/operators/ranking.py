"""Numbers of rows in an order, within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.stored import stored


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "number") -> DataFrame:
    """rows with their number, from 1, in the order within their group (columns by, null or not).

    Rows are sorted over range partitions, so a group may span many of them; a row's number is its number in its own part of the group
    and the rows of the group's parts before. Of the parts there are as many as groups and partitions at most.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    dealt = stored(rows.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one group at most goes on from part to part
    later = counts.withColumn("_before", F.sum("_n").over(before)).filter("_before is not null").drop("_n")
    later = later.select("_part", "_before", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    found = dealt.withColumn("_own", own).join(F.broadcast(later.withColumnRenamed("_part", "_p")), same, "left")  # a row a partition at most
    return found.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, under each name in shares, the value of nearest rank: the least that so large a share of the group's values doesn't exceed. Nulls don't count."""
    ranked = numbered(rows.filter(F.col(value).isNotNull()).select(*by, value), by, [value], "_i")
    sizes = ranked.groupBy(*by).agg(F.max("_i").alias("_n"))
    wanted = [F.struct(F.lit(name).alias("_name"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n"))).cast("long").alias("_i")) for name, p in shares.items()]
    asked = sizes.select(*by, F.inline(F.array(*wanted)))
    same = [F.col(f"_by{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
    asked = asked.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_name", F.col("_i").alias("_rank"))
    hit = ranked.join(asked, [*same, F.col("_i") == F.col("_rank")])
    return hit.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in shares])
