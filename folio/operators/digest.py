"""Digests of ordered lists of any length, as trees of hashes with a shape that follows from the list alone, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import ranking

FAN = 1024


def listed(rows: DataFrame, by: list[str], order: list[str], text: Column, *, fan: int = FAN, levels: int | None = None, name: str = "version") -> DataFrame:
    """by (none for one list) and name, the digest of each list: of its texts in order, which must tell all rows apart.

    Rows are numbered and hashed where they lie; fan hashes that follow each other are hashed as one, and so on until
    one is left. A task gathers fan hashes at a time. With levels, what is left after one less is hashed as one, which a task then
    gathers: of two levels, 64 bytes for each fan rows of a list.
    """
    leaf = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    now = ranking.numbered(rows.select(*by, *[c for c in order if c not in by], leaf.alias("_hash")), by, order, "_i").select(*by, (F.col("_i") - 1).alias("_i"), "_hash")
    longest = now.agg(F.max("_i")).first()[0]
    done, level = None, 0
    while longest is not None:
        level += 1
        last = level == levels
        above = now.groupBy(*by, (F.lit(0).cast("long") if last else F.expr(f"_i div {fan}")).alias("_j")).agg(F.array_sort(F.collect_list(F.struct("_i", "_hash"))).alias("_parts"))
        joined = F.array_join(F.transform("_parts", lambda p: p["_hash"]), "")
        now = above.select(*by, F.col("_j").alias("_i"), F.sha2(joined.cast("binary"), 256).alias("_hash"))
        longest = 0 if last else longest // fan
        # a list is done with the first level that has one hash of it
        counts = now.groupBy(*by).agg(F.max("_i").alias("_last"), F.max(F.when(F.col("_i") == 0, F.col("_hash"))).alias(name))
        one = counts.filter("_last = 0").select(*by, name)
        done = one if done is None else done.unionByName(one)
        if not longest:
            return done
        if by:  # null is a group too
            more = counts.filter("_last > 0").select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
            same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
            now = now.join(more, same, "left_semi")
    return rows.select(*by, F.lit("").alias(name)).limit(0)


def joined(rows: DataFrame, by: list[str], order: list[str], text: Column, separator: str, *, fan: int = FAN, name: str = "keys") -> DataFrame:
    """by and name: the texts of each list in order, with a separator between them. Pieces of fan texts are put together first, so the task that has a whole list holds little more than the result."""
    now = ranking.numbered(rows.select(*by, *[c for c in order if c not in by], text.alias("_text")), by, order, "_i")
    pieces = now.groupBy(*by, F.expr(f"(_i - 1) div {fan}").alias("_j")).agg(F.array_sort(F.collect_list(F.struct("_i", "_text"))).alias("_parts"))
    pieces = pieces.select(*by, "_j", F.array_join(F.transform("_parts", lambda p: p["_text"]), separator).alias("_text"))
    whole = pieces.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_j", "_text"))).alias("_parts"))
    return whole.select(*by, F.array_join(F.transform("_parts", lambda p: p["_text"]), separator).alias(name))


def sql(table: str, by: str, order: str, text: str, fan: int = FAN) -> str:
    """DuckDB SQL for columns by and version: what listed gives with two levels."""
    return f"""WITH leaf AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS i, sha256(coalesce({text}, '')) AS h FROM {table}),
one AS (SELECT {by}, i // {fan} AS j, sha256(string_agg(h, '' ORDER BY i)) AS h FROM leaf GROUP BY 1, 2)
SELECT {by}, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY j)) END AS version FROM one GROUP BY 1"""
