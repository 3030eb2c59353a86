"""Which rows a reader may see: one predicate that all reads share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def under(key: Column, top: Column) -> Column:
    """key is top or lies below it in a path with slashes."""
    return (key == top) | F.startswith(key, F.concat(top, F.lit("/")))


def prefixes(key: Column) -> Column:
    """The paths that key lies under, itself the last."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def visible(articles: DataFrame, laws: DataFrame, entries: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of articles in the catalogue: of the law's current revision, not deleted, and in a full or unverified entry or in one of its ranges.

    articles: id (unique), law_id, revision, key, deleted_at; laws: law_id, current; entries: entry_id, law_id, mode,
    status; ranges: entry_id, top. Ranges are read for excerpts alone. Articles of laws without a full entry are laid out
    by what their key lies under, so the ranges, any number of them, are met by equality; what is met is a set of ids.
    """
    live = articles.filter(F.col("deleted_at").isNull()).join(laws.select("law_id", F.col("current").alias("revision")), ["law_id", "revision"], "left_semi")
    whole = (F.col("mode") == "full") | (F.col("status") != "verified")
    full = entries.filter(whole).select("law_id").distinct()
    tops = entries.filter(~whole).join(ranges, "entry_id").select("law_id", "top")
    rest = live.join(full, "law_id", "left_anti")
    met = rest.select("id", "law_id", F.explode(prefixes(F.col("key"))).alias("top")).join(tops, ["law_id", "top"], "left_semi")
    found = live.join(full, "law_id", "left_semi").unionByName(rest.join(met.select("id"), "id", "left_semi").select(*live.columns))
    return found.select(*articles.columns)


def of_organization(rows: DataFrame, organization: int | str) -> DataFrame:
    """The rows that one organisation may see; a row without an organisation is seen by none."""
    return rows.filter(F.col("organization") == organization)


def has_role(held: Column, required: list[str]) -> Column:
    """Whether one of the required roles is held."""
    return F.coalesce(F.arrays_overlap(held, F.array(*[F.lit(r) for r in required])), F.lit(False))
