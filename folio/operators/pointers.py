"""Following pointers by doubling: each round joins what is known with itself, so h hops take log2(h) rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.stored import stored

#: Hops up to which a chain is followed.
MAX_HOPS = 120


def chains(mapping: DataFrame, *, most: int = MAX_HOPS) -> DataFrame:
    """start, last, hops and outcome (end, removed, cycle or too_long) of following from_id (unique) -> to_id; a null to_id is a removal.

    After k rounds each row knows where 2**k hops lead, so ceil(log2(most + 1)) rounds tell all chains of up to most hops; what is still
    open then is followed once more with the ids on its way. On a cycle last is the first id met again, after hops hops; a longer chain has
    neither. Many rows may point at one: their side of the join has no bound for a key, which adaptive execution splits.
    """
    rounds = max(1, math.ceil(math.log2(most + 1)))
    known = mapping.select(F.col("from_id").alias("to"), F.lit(True).alias("more"))
    now = mapping.select(F.col("from_id").alias("start"), F.col("to_id").alias("to")).join(known, "to", "left")
    state = F.when(F.col("to").isNull(), "removed").when(F.col("more").isNull(), "end")
    now = stored(now.select("start", "to", F.lit(1).cast("long").alias("hops"), state.alias("outcome")), "chains")
    for _ in range(rounds):
        there = now.select(F.col("start").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), "outcome")
        moved = now.filter("outcome is null").drop("outcome").join(there, "to").select("start", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), "outcome")
        now = stored(now.filter("outcome is not null").unionByName(moved), "chains")
    done = now.filter("outcome is not null").select("start", F.col("to").alias("last"), "hops", "outcome")
    long = F.col("hops") > most
    done = done.select("start", F.when(~long, F.col("last")).alias("last"), F.when(~long, F.col("hops")).alias("hops"), F.when(long, "too_long").otherwise(F.col("outcome")).alias("outcome"))
    left = now.filter("outcome is null").select("start")
    if not left.head(1):
        return done
    # those on or before a cycle lead to open rows alone; of a longer chain the last ones do not
    way = stored(mapping.join(left.withColumnRenamed("start", "from_id"), "from_id", "left_semi").select(F.col("from_id").alias("start"), F.col("to_id").alias("to"), F.array("from_id").alias("way")), "ways")
    for _ in range(rounds):
        there = way.select(F.col("start").alias("to"), F.col("to").alias("_to"), F.col("way").alias("_way"))
        way = stored(way.join(there, "to", "left").select("start", F.col("_to").alias("to"), F.concat("way", F.coalesce("_way", F.slice("way", 1, 0))).alias("way")), "ways")
    hops = F.size(F.array_distinct("way"))
    met = (hops < F.size("way")) & (hops <= most)
    open_rows = way.select("start", F.when(met, F.get("way", hops)).alias("last"), F.when(met, hops.cast("long")).alias("hops"), F.when(met, "cycle").otherwise("too_long").alias("outcome"))
    return done.unionByName(open_rows)


def routes(asked: DataFrame, articles: DataFrame, mapping: DataFrame, *, most: int = MAX_HOPS) -> DataFrame:
    """id, outcome, target and reason of each asked id.

    articles: id and current (whether it belongs to the version in force). mapping: from_id (unique), to_id and status. An article in force is
    current; another is followed to the first one in force (redirect, target), a removal (removed), or an end: one with no
    mapping or to an unknown article (historical, unmapped) or with an ambiguous mapping (historical, ambiguous). An unknown id is missing;
    a cycle, or more than most hops, is cycle.
    """
    known = articles.select(F.col("id").alias("to_id"), F.lit(True).alias("known"))
    old = articles.filter("not current").select(F.col("id").alias("from_id"))
    clear = mapping.filter("status <> 'ambiguous' or status is null").join(old, "from_id", "left_semi").join(known, "to_id", "left")
    clear = clear.filter("known or to_id is null").select("from_id", "to_id")
    followed = chains(clear, most=most).select(F.col("start").alias("id"), "last", F.col("outcome").alias("way"))
    in_force = articles.filter("current").select(F.col("id").alias("last"), F.lit(True).alias("reached"))
    unclear = mapping.filter("status = 'ambiguous'").select(F.col("from_id").alias("end_id"), F.lit(True).alias("unclear"))
    rows = asked.select("id").join(articles.select("id", "current"), "id", "left").join(followed, "id", "left").join(in_force, "last", "left")
    end = F.when(F.col("way").isNull(), F.col("id")).when(F.col("way") == "end", F.col("last"))
    rows = rows.withColumn("end_id", end).join(unclear, "end_id", "left")
    outcome = (
        F.when(F.col("current").isNull(), "missing").when(F.col("current"), "current").when(F.col("way") == "removed", "removed")
        .when(F.col("way").isin("cycle", "too_long"), "cycle").when(F.col("reached"), "redirect").otherwise("historical")
    )
    rows = rows.withColumn("outcome", outcome)
    target = F.when(F.col("outcome") == "current", F.col("id")).when(F.col("outcome") == "redirect", F.col("last"))
    reason = F.when(F.col("outcome") == "historical", F.when(F.col("unclear"), "ambiguous").otherwise("unmapped"))
    return rows.select("id", "outcome", target.alias("target"), reason.alias("reason"))


def lineage(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent, place) with depth, ancestors (ids from the root), path (places from the root), keys (places and ids, for document order) and root.

    Round k joins each node's known ancestors with those of the topmost of them; there is no bound on the depth. A round in
    which nothing reaches a root leaves only nodes on or below a cycle, which are left out like those below a missing parent.
    """
    own = F.array(F.struct("place", "id"))
    now = stored(nodes.select("id", "parent", "place", F.col("parent").alias("to"), own.alias("keys")), "lineage")
    waiting = now.filter("to is not null").count()
    while waiting:
        there = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("keys").alias("_keys"))
        moved = now.filter("to is not null").join(there, "to").select("id", "parent", "place", F.col("_to").alias("to"), F.concat("_keys", "keys").alias("keys"))
        now = stored(now.filter("to is null").unionByName(moved), "lineage")
        before, waiting = waiting, now.filter("to is not null").count()
        if waiting == before:
            break
    ids = F.transform("keys", lambda k: k["id"])
    above = F.slice(ids, F.lit(1), F.size("keys") - 1)
    path = F.transform("keys", lambda k: k["place"])
    return now.filter("to is null").select("id", "parent", "place", (F.size("keys") - 1).alias("depth"), above.alias("ancestors"), path.alias("path"), "keys", F.get(ids, F.lit(0)).alias("root"))


def on_cycles(nodes: DataFrame) -> DataFrame:
    """ids of the nodes (id, parent) whose way up never ends: those on a cycle and those that hang on one.

    Each round lets every way jump to where its end's way leads; a round in which none ends leaves those that never do.
    """
    now = stored(nodes.select("id", F.col("parent").alias("to")), "cycles")
    known = now.select(F.col("id").alias("to"), F.lit(True).alias("known"))
    now = stored(now.join(known, "to", "left").select("id", F.when(F.col("known"), F.col("to")).alias("to")), "cycles")
    waiting = now.filter("to is not null").count()
    while waiting:
        there = now.select(F.col("id").alias("to"), F.col("to").alias("_to"))
        moved = now.filter("to is not null").join(there, "to").select("id", F.col("_to").alias("to"))
        now = stored(now.filter("to is null").unionByName(moved), "cycles")
        before, waiting = waiting, now.filter("to is not null").count()
        if waiting == before:
            break
    return now.filter("to is not null").select("id")
