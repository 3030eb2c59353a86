"""Substring search, ranking and snippets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPET = 150


def escape_html(c: Column) -> Column:
    """The five characters that HTML reserves, ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def snippet(text: Column, term: str, width: int = SNIPPET) -> Column:
    """About width characters around the first hit, the hit in <mark>; the head of the text if there is no hit."""
    hit = F.instr(text, term)
    n = len(term)
    around = max(0, (width - n) // 2)
    start = F.greatest(F.lit(1), hit - around)
    stop = F.least(F.length(text) + 1, hit + n + around)
    marked = F.concat(
        F.when(start > 1, F.lit("…")).otherwise(F.lit("")),
        escape_html(F.substr(text, start, hit - start)),
        F.lit("<mark>"), escape_html(F.substr(text, hit, F.lit(n))), F.lit("</mark>"),
        escape_html(F.substr(text, hit + n, stop - hit - n)),
        F.when(stop <= F.length(text), F.lit("…")).otherwise(F.lit("")),
    )
    head = F.concat(escape_html(F.substr(text, F.lit(1), F.lit(width))), F.when(F.length(text) > width, F.lit("…")).otherwise(F.lit("")))
    return F.when(hit > 0, marked).otherwise(head)


def search(docs: DataFrame, term: str, *, key: str, fields: dict[str, Column], order: list[Column], limit: int = 20, width: int = SNIPPET) -> DataFrame:
    """Rows where any field contains term; first field's hits lead, then order; limit is the feature.

    fields: name -> Column, the heading first and the body last. Null fields never match.
    """
    names = list(fields)
    hits = {n: F.coalesce(F.contains(c, F.lit(term)), F.lit(False)) for n, c in fields.items()}
    source = F.lit(None).cast("string")
    for n in reversed(names):
        source = F.when(hits[n], F.lit(n)).otherwise(source)
    found = F.lit(False)
    for c in hits.values():
        found = found | c
    rank = F.when(hits[names[0]], 0).otherwise(1)
    return (
        docs.filter(found)
        .select(F.col(key), source.alias("match_source"), rank.alias("match_rank"), snippet(F.coalesce(fields[names[-1]], F.lit("")), term, width).alias("snippet"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
        .orderBy("match_rank", *[f"_o{i}" for i in range(len(order))], key)
        .limit(limit)
        .drop(*[f"_o{i}" for i in range(len(order))])
    )
