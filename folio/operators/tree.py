"""What is read off a tree of which each node knows its ancestors: breadcrumbs, scopes, values carried down, regrouped leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def breadcrumbs(tree: DataFrame) -> DataFrame:
    """id, step and ancestor, from the root down."""
    return tree.select("id", F.posexplode("ancestors").alias("step", "ancestor"))


def carried(flag: Column, value: Column, keys: list[str], order: list[Column]) -> Column:
    """value of the latest row so far where flag holds."""
    return F.last(F.when(flag, value), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def nearest_scope(tree: DataFrame, level: Column, priority: list[str]) -> DataFrame:
    """id and scope: of a node and its ancestors the one whose level comes first in priority, the deepest of several; else the root."""
    chain = tree.select("id", "root", F.posexplode(F.concat("ancestors", F.array("id"))).alias("step", "scope"))
    listed = F.array_position(F.array(*[F.lit(p) for p in priority]), level)
    levels = tree.select(F.col("id").alias("scope"), listed.alias("rank")).filter("rank > 0")
    ranked = chain.join(levels, "scope", "left")
    order = F.when(F.col("rank").isNotNull(), F.struct("rank", -F.col("step")))
    return ranked.groupBy("id").agg(F.coalesce(F.min_by("scope", order), F.min("root")).alias("scope"))


def regrouped(tree: DataFrame, member: Column, prefix: str, place: int) -> DataFrame:
    """id, parent and path after leaves where member holds move below one new node of their parent, at place."""
    flagged = tree.withColumn("_m", F.coalesce(member, F.lit(False)))
    above = F.slice("path", 1, F.size("path") - 1)
    moved, order = flagged.filter("_m"), Window.partitionBy("parent").orderBy("path", "id")
    group = F.concat(F.lit(prefix), "parent")
    below = moved.select("id", group.alias("parent"), F.concat(above, F.array(F.lit(place), F.row_number().over(order))).alias("path"))
    heads = moved.select(group.alias("id"), "parent", F.concat(above, F.array(F.lit(place))).alias("path")).dropDuplicates(["id"])
    return flagged.filter("not _m").select("id", "parent", "path").unionByName(heads).unionByName(below)
