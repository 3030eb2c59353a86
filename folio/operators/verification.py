"""Whether candidate revisions may be published: all eight checks of their nodes, differences and ranges, for any number of laws at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import pointers

#: Share of a law's nodes that may come or go without a review.
MOST_CHANGED = 0.2
GUARD = "STRUCTURE_CHANGE_REVIEW_REQUIRED"
#: Kinds of differences that only a reviewed decision lets pass.
HELD = ("renumbered", "ambiguous")


def _found(rows: DataFrame, code: str, node: Column, detail: Column) -> DataFrame:
    return rows.select("law", F.lit(code).alias("code"), node.cast("string").alias("node"), detail.cast("string").alias("detail"))


def _repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The second and each further row of a key, in order of index."""
    nth = F.row_number().over(Window.partitionBy("law", *keys).orderBy("index"))
    return rows.withColumn("_nth", nth).filter("_nth > 1")


def errors(laws: DataFrame, nodes: DataFrame, diff: DataFrame, ranges: DataFrame, mappings: DataFrame, guards: DataFrame, most: float = MOST_CHANGED) -> DataFrame:
    """law, code, node and detail of whatever keeps a law's candidate from being published.

    laws: law, nodes_before; nodes: law, index (unique in a law), parent (an index), key, level, number; diff: law, key_before, key_after, kind; ranges: law,
    range_id, status, reason; mappings: law, from_key, to_key and guards: law, guard of reviewed decisions. Of a law's differences that no
    decision covers one is named, that with the least key. A pair is covered by a mapping of just these two keys, one key by any mapping of it.
    """
    ids = nodes.select("*", F.concat_ws("/", "law", "index").alias("id"), F.when(F.col("parent").isNotNull(), F.concat_ws("/", "law", "parent")).alias("above"))
    known = ids.select(F.col("id").alias("above"), F.lit(True).alias("known"))
    ids = ids.join(known, "above", "left")
    counts = nodes.groupBy("law").agg(F.count(F.lit(1)).alias("now"))
    sized = laws.join(counts, "law", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    cycle = pointers.on_cycles(ids.select("id", F.col("above").alias("parent")))
    place = F.when(F.col("parent").isNull(), "root").when(F.col("known"), F.col("parent").cast("string")).otherwise("missing")
    numbered = ids.filter("number is not null and number <> ''").withColumn("_place", place)

    held = diff.filter(F.col("kind").isin(*HELD))
    pairs = mappings.select("law", F.col("from_key").alias("key_before"), F.col("to_key").alias("key_after"), F.lit(True).alias("pair")).distinct()
    ends = [mappings.select("law", F.col(c).alias(k), F.lit(True).alias(n)).distinct() for c, k, n in (("from_key", "key_before", "from"), ("to_key", "key_after", "to"))]
    held = held.join(pairs, ["law", "key_before", "key_after"], "left").join(ends[0], ["law", "key_before"], "left").join(ends[1], ["law", "key_after"], "left")
    both = F.col("key_before").isNotNull() & F.col("key_after").isNotNull()
    covered = F.when(both, F.col("pair")).otherwise(F.coalesce("from", "to"))
    open_diff = held.filter(covered.isNull()).groupBy("law").agg(F.min(F.struct(F.coalesce("key_before", "key_after").alias("key"), F.coalesce("key_before", F.lit("")).alias("before"), F.coalesce("key_after", F.lit("")).alias("after"))).alias("one"))

    share = (F.col("now") - F.col("nodes_before")) / F.col("nodes_before")
    moved = sized.filter((F.col("nodes_before") > 0) & (F.abs(share) >= most)).join(guards.filter(F.col("guard") == GUARD), "law", "left_anti")
    parts = [
        _found(sized.filter("now = 0"), "EMPTY_DOCUMENT", F.lit(None), F.col("now")),
        _found(_repeats(nodes, ["key"]), "DUPLICATE_DURABLE_KEY", F.col("key"), F.col("index")),
        _found(ids.filter("above is not null and known is null"), "ORPHAN_NODE", F.col("key"), F.col("parent")),
        _found(ids.join(cycle, "id", "left_semi"), "CYCLE_DETECTED", F.col("key"), F.col("index")),
        _found(_repeats(numbered, ["_place", "level", "number"]), "COLLISION_SIBLING_NUMBER", F.col("key"), F.concat_ws(":", "level", "number")),
        _found(open_diff, "UNRESOLVED_DIFF", F.col("one.key"), F.concat_ws(" -> ", "one.before", "one.after")),
        _found(ranges.filter("status <> 'resolved'"), "RANGE_UNRESOLVED", F.col("range_id"), F.col("reason")),
        _found(moved, GUARD, F.lit(None), F.round(share, 4)),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(laws: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """law, nodes, articles, changed (share of the nodes before; 0 for a first candidate), errors and publishable of each law."""
    counts = nodes.groupBy("law").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("level") == "article").alias("articles"))
    errors_of = found.groupBy("law").agg(F.count(F.lit(1)).alias("errors"))
    rows = laws.join(counts, "law", "left").join(errors_of, "law", "left").fillna(0, ["nodes", "articles", "errors"])
    changed = F.when(F.col("nodes_before") > 0, F.round((F.col("nodes") - F.col("nodes_before")) / F.col("nodes_before"), 4)).otherwise(0.0)
    return rows.select("law", "nodes", "articles", changed.alias("changed"), "errors", (F.col("errors") == 0).alias("publishable"))
