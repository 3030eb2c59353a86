"""Comparison of two revisions and the checks before one is published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """key_before, key_after and kind of each node of two revisions (key, parent, body, content).

    Same key: unchanged or modified by content. Nodes left over on both sides pair up by parent and
    body: one and one is renumbered (one row for the pair), more are ambiguous (a row each), others removed or added.
    """
    a = before.select("key", F.col("content").alias("_a"), F.col("parent").alias("_pa"), F.col("body").alias("_ba"), F.lit(1).alias("in_a"))
    b = after.select("key", F.col("content").alias("_b"), F.col("parent").alias("_pb"), F.col("body").alias("_bb"), F.lit(1).alias("in_b"))
    both = a.join(b, "key", "full_outer")
    same = both.filter("in_a = 1 and in_b = 1").select(F.col("key").alias("key_before"), F.col("key").alias("key_after"), F.when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("modified").alias("kind"))
    left = both.filter("in_a is null or in_b is null").select("key", F.coalesce("_pa", "_pb").alias("parent"), F.coalesce("_ba", "_bb").alias("body"), (F.col("in_a") == 1).alias("gone"))
    gone = F.coalesce("gone", F.lit(False))
    groups = left.groupBy("parent", "body").agg(
        F.count_if(gone).alias("n_a"), F.count_if(~gone).alias("n_b"), F.min(F.when(gone, F.col("key"))).alias("one_a"), F.min(F.when(~gone, F.col("key"))).alias("one_b"),
    )
    renamed = groups.filter("n_a = 1 and n_b = 1").select(F.col("one_a").alias("key_before"), F.col("one_b").alias("key_after"), F.lit("renumbered").alias("kind"))
    many = groups.filter("not (n_a = 1 and n_b = 1)").select("parent", "body", "n_a", "n_b")
    rest = left.join(many, (left.parent.eqNullSafe(many.parent)) & (left.body.eqNullSafe(many.body)))
    kind = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), "ambiguous").when(gone, "removed").otherwise("added")
    rest = rest.select(F.when(gone, F.col("key")).alias("key_before"), F.when(~gone, F.col("key")).alias("key_after"), kind.alias("kind"))
    return same.unionByName(renamed).unionByName(rest)


def tallied(diff: DataFrame) -> DataFrame:
    """One row: a count for each kind, held (needs review) and publishable."""
    kinds = ["unchanged", "modified", "renumbered", "ambiguous", "removed", "added"]
    held = F.count_if(F.col("kind").isin("renumbered", "ambiguous", "removed"))
    return diff.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], held.alias("held")).withColumn("publishable", F.col("held") == 0)


def findings(df: DataFrame, code: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), key.cast("string").alias("node"), detail.cast("string").alias("detail"))


def duplicates(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """A finding for each key that occurs more than once, with its count."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return findings(found, code, F.concat_ws("/", *keys), F.col("n"))


def orphans(df: DataFrame, key: str, parent: str, parents: DataFrame, parent_key: str, code: str) -> DataFrame:
    """A finding for each row whose parent is missing."""
    known = parents.select(F.col(parent_key).alias("_known"))
    lost = df.filter(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_known"), "left_anti")
    return findings(lost, code, F.col(key), F.col(parent))


def later_repeats(df: DataFrame, keys: list[str], order: list[str], key: str, code: str) -> DataFrame:
    """A finding for the second and each further row of a key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return findings(df.withColumn("_n", number).filter("_n > 1"), code, F.col(key), F.col("_n"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gate(found: DataFrame, errors: list[str], most_warnings: int = 10) -> DataFrame:
    """One row: errors, warnings and whether the candidate may be published."""
    is_error = F.col("code").isin(errors)
    return found.agg(F.count_if(is_error).alias("errors"), F.count_if(~is_error).alias("warnings")).withColumn("publish", (F.col("errors") == 0) & (F.col("warnings") <= most_warnings))


def moved(before: DataFrame, after: DataFrame, least: int = 30) -> DataFrame:
    """before, after (keys) and kind of the texts of two revisions (key, text), by fingerprint.

    Same key: unchanged or modified. A removed text of more than least characters that was added elsewhere has moved, to
    the last key that has it; others are removed or added.
    """
    print_of = F.left(F.sha2(F.col("text").cast("binary"), 256), F.lit(16))
    a = before.select("key", print_of.alias("a"), (F.length("text") > least).alias("long"), F.lit(True).alias("in_a"))
    b = after.select("key", print_of.alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "key", "full_outer")
    same = both.filter("in_a and in_b").select(F.col("key").alias("before"), F.col("key").alias("after"), F.when(F.col("a") == F.col("b"), "unchanged").otherwise("modified").alias("kind"))
    gone, come = both.filter("in_b is null"), both.filter("in_a is null")
    last = come.groupBy(F.col("b").alias("a")).agg(F.max("key").alias("to"))
    gone = gone.join(last, "a", "left").withColumn("to", F.when(F.col("long"), F.col("to")))
    left = gone.select(F.col("key").alias("before"), F.col("to").alias("after"), F.when(F.col("to").isNull(), "removed").otherwise("moved").alias("kind"))
    taken = gone.filter("to is not null").select(F.col("to").alias("key")).distinct()
    new = come.join(taken, "key", "left_anti").select(F.lit(None).cast("long").alias("before"), F.col("key").alias("after"), F.lit("added").alias("kind"))
    return same.unionByName(left).unionByName(new)


def set_equality(stored: DataFrame, source: DataFrame) -> DataFrame:
    """law, code and problems of two sides (key, law, checksum) that must hold the same rows; of several errors the first in order counts."""
    a, b = stored.select("key", F.col("law").alias("la"), F.col("checksum").alias("ca")), source.select("key", F.col("law").alias("lb"), F.col("checksum").alias("cb"))
    both = a.join(b, "key", "full_outer")
    code = F.when(F.col("cb").isNull(), 1).when(F.col("ca").isNull(), 2).when(F.col("ca") != F.col("cb"), 3)
    first = F.min(code)
    name = F.when(first == 1, "SOURCE_MISSING").when(first == 2, "STORED_MISSING").when(first == 3, "CHECKSUM_MISMATCH").otherwise("OK")
    return both.groupBy(F.coalesce("la", "lb").alias("law")).agg(name.alias("code"), F.count(code).alias("problems"))
