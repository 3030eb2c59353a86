"""What readers look at together, recommendations from it, and rules by conditions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.stored import stored, tasks

MINUTES = 30


def cooccurrences(views: DataFrame, *, minutes: int = MINUTES) -> DataFrame:
    """item, related and n: how often a user went from item to another within minutes. views: user, ts, tie, item."""
    order = Window.partitionBy("user").orderBy("ts", "tie")
    pairs = views.select("item", "ts", F.lag("item").over(order).alias("before"), F.lag("ts").over(order).alias("since"))
    near = (F.col("before") != F.col("item")) & (F.col("ts") <= F.col("since") + F.expr(f"INTERVAL '{minutes}' MINUTE"))
    return pairs.filter(near).groupBy(F.col("before").alias("item"), F.col("item").alias("related")).agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    """Counts of several sources added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("item", "related").agg(F.sum("n").alias("n"))


def recommended(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent related items of each item; k is the feature."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "related"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Items of a pack that one task pairs with as many others at a time.
BLOCK = 100
#: Pairs of items that one task counts: of more pairs more tasks.
PAIRS = 1_000_000


def _counted(packs: DataFrame, block: int, pairs: int) -> tuple[DataFrame, int]:
    """item, related and n of pack_counts, to be run over so many tasks at least: then none holds more than pairs of them, however many there are."""
    spark, packs = packs.sparkSession, packs.select("pack", "item").dropna()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tasks(spark, max(least, math.ceil(packs.count() / pairs))):
        packs = stored(packs.distinct(), "packs")
        sizes = packs.groupBy("pack").agg(F.count(F.lit(1)).alias("n"))
        every = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    n = max(least, math.ceil(every / pairs))
    dealt = packs.join(sizes.select("pack", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "pack").withColumn("own", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    left = dealt.select("pack", F.col("item").alias("x"), F.col("own").alias("a"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("b"))
    right = dealt.select("pack", F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("a"), F.col("own").alias("b"))
    keys = ["pack", "a", "b"]
    # dealt by number, as small rows that become many pairs would be put together again by their size
    met = left.repartition(n, *keys).join(right.repartition(n, *keys), keys).filter("a < b or x < y")
    once = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    both = F.array(*[F.struct(F.col(i).alias("item"), F.col(j).alias("related"), F.col("n").alias("n")) for i, j in ("xy", "yx")])
    return once.select(F.inline(both)), n


def pack_counts(packs: DataFrame, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """item, related and n: in how many packs two items are together. packs: pack, item.

    A pack's items are dealt into blocks by their hash, and each two blocks meet on their own, so a large pack's pairs are spread
    over tasks; two items are counted once for both orders, before they are shuffled.
    """
    counts, n = _counted(packs, block, pairs)
    with tasks(packs.sparkSession, n):
        return stored(counts, "pack-counts")


def cold_start(packs: DataFrame, k: int, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """Items that share a pack with an item, most shared first."""
    counts, n = _counted(packs, block, pairs)
    with tasks(packs.sparkSession, n):
        return stored(recommended(counts, k), "cold-start")


def with_fallback(seen: DataFrame, shared: DataFrame, views: DataFrame, k: int, *, least: int = 50) -> DataFrame:
    """item, related, source and rank: of items with least views at least what was seen after them, of others, and where nothing was, what shares a pack."""
    warm = views.filter(F.col("views") >= least).select("item")
    first = seen.join(warm, "item", "left_semi").withColumn("source", F.lit("seen together"))
    rest = shared.join(first.select("item").distinct(), "item", "left_anti").withColumn("source", F.lit("pack"))
    return recommended(first.unionByName(rest), k).select("item", "related", "source", "rank")


def matching_rules(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """Rules whose JSON list of values has the value that a subject has under the rule's key. conditions: subject, key, value."""
    listed = rules.withColumn("value", F.explode(F.from_json("condition_values", "array<string>"))).dropDuplicates(["rule_id", "value"])
    return conditions.join(listed, (conditions.key == listed.condition_key) & (conditions.value == listed.value)).select("subject", "rule_id", "label", "level", "place")


def highlights(matched: DataFrame) -> DataFrame:
    """For each subject the level of its first rule, and the labels of all in order."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "rule_id", "label")))
    return matched.groupBy("subject").agg(F.min_by("level", F.struct("place", "rule_id")).alias("level"), F.count(F.lit(1)).alias("n_rules"), F.array_distinct(F.transform(ordered, lambda x: x.label)).alias("labels"))


def rule_groups(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """rule_id, label, condition_key, articles and unmatched of every rule: how many articles it marks, and what a reader is told where it marks none."""
    counts = matched.groupBy("rule_id").agg(F.count(F.lit(1)).alias("articles"))
    rows = rules.select("rule_id", "label", "condition_key").join(counts, "rule_id", "left")
    return rows.select("rule_id", "label", "condition_key", F.coalesce("articles", F.lit(0)).alias("articles"), F.when(F.col("articles").isNull(), F.concat("label", F.lit("（条件値未選択）"))).alias("unmatched"))


def marked(rules: DataFrame, matched: DataFrame) -> DataFrame:
    """subject, level, types and given of each marked subject: of its rules in order the first one's level, the kinds of conditions and all their values, each once."""
    told = matched.join(rules.select("rule_id", "condition_key", F.from_json("condition_values", "array<string>").alias("given")), "rule_id")
    rows = F.array_sort(F.collect_list(F.struct("place", "rule_id", "level", "condition_key", "given")))  # a subject's rules
    out = told.groupBy("subject").agg(rows.alias("rows"))
    return out.select("subject", F.get("rows", F.lit(0))["level"].alias("level"), F.array_distinct(F.transform("rows", lambda r: r["condition_key"])).alias("types"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["given"]))).alias("given"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null for nothing."""
    return F.when(whole != 0, part / whole)
