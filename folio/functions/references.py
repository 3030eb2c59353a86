"""Links and citations in texts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from folio.functions import numerals, scan

_KANJI = "[一二三四五六七八九十百千]+"
_NUM = rf"(?:{_KANJI}|[0-9]+|[０-９]+)"
_ARTICLE = rf"第{_NUM}条(?:の{_NUM})*"
# What a reference may begin with, the law that it names and the level that it leads to.
KINDS = (("法第", "act", "article"), ("令第", "order", "article"), ("別表第", "same", "appendix"), ("付表第", "same", "appendix"), ("第", "same", "article"))
#: No two kinds begin at one place and none begins within another but an article's own, so the first from the left is the one that counts.
_ANY = re.compile(rf"[法令]{_ARTICLE}|(?:別表|付表)第{_NUM}|(?<![法令]){_ARTICLE}")


def _references(text: str | None):
    for m in _ANY.finditer(text or ""):
        yield m.start(), m.end(), m[0]


def detected(texts: DataFrame) -> DataFrame:
    """id, start, end (in code points), reference, number, law and level of each reference in texts (id, text), from left to right."""
    found = scan.scanned(texts, ["text"], ["id"], _references, "start int, end int, reference string")
    law, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for head, own, kind in KINDS[::-1]:
        law, level = (F.when(F.startswith("reference", F.lit(head)), x).otherwise(y) for x, y in ((own, law), (kind, level)))
    number = F.replace(F.regexp_replace("reference", "^(?:[法令]|別表|付表)?第", ""), F.lit("条"), F.lit(""))
    return found.select("id", "start", "end", "reference", numerals.article_number(number).alias("number"), law.alias("law"), level.alias("level"))


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("linked", BooleanType())])))
def split_by_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """A text cut at the edges of its spans (start and end, in order, none overlapping), and which parts are links."""

    def one(t: str, own) -> list[dict]:
        out, at = [], 0
        for s in own if own is not None else ():
            if s["start"] > at:
                out.append({"text": t[at : s["start"]], "linked": False})
            out.append({"text": t[s["start"] : s["end"]], "linked": True})
            at = s["end"]
        return [*out, {"text": t[at:], "linked": False}] if at < len(t) else out

    return pd.Series([one(t or "", s) for t, s in zip(text, spans)])


def resolved(found: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """found with target where a target has its key (one for each), null otherwise."""
    known = targets.groupBy(*keys).agg(F.min("target").alias("target"))
    return found.join(known, keys, "left")


def resolution_rate(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("references"), F.count("target").alias("resolved"), F.avg(F.col("target").isNotNull().cast("double")).alias("rate"))


def without_overlap(spans: DataFrame) -> DataFrame:
    """Spans (id, start, end, rank) as they are merged: those of rank 0 are stored and stay; the others, by rank, start and end, stay where nothing that stays by then overlaps them.

    What a span meets depends on each decision before it, so the sorted spans of one id (one text's) are gone through
    in order; a task holds what the present id has claimed and no more. A span without a start, an end or a rank is none.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, starts, ends = None, [], []
        for b in batches:
            keep = []
            for own, start, end, rank in zip(*(b.column(c).to_pylist() for c in ("id", "start", "end", "rank"))):
                if own != now:
                    now, starts, ends = own, [], []
                at = bisect_left(starts, end)  # of the disjoint runs claimed so far, those that begin before the end
                stays = not rank or not at or ends[at - 1] <= start
                keep.append(stays)
                if stays and end > start:
                    first = bisect_left(ends, start)
                    last = max(first, bisect_right(starts, end))
                    starts[first:last], ends[first:last] = [min([start, *starts[first:last]])], [max([end, *ends[first:last]])]
            yield b.filter(pa.array(keep, pa.bool_()))

    dealt = spans.dropna(subset=["start", "end", "rank"]).repartition("id").sortWithinPartitions("id", "rank", "start", "end")
    return dealt.mapInArrow(merged, spans.schema)


def hrefs(html: Column) -> Column:
    """Targets of the links in a page, in order, repeats included."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def relative_path(word: Column, here: Column) -> Column:
    """Where a word like 'the preceding article' leads to from a path (art5-2/para3/item1); null for ranges and outside articles."""
    article = F.regexp_extract(here, "^art([0-9]+)", 1).try_cast("long")
    paragraph = F.regexp_extract(here, "para([0-9]+)", 1).try_cast("long")

    def path(n, p=None):
        return F.concat(F.lit("art"), n.cast("string"), *([] if p is None else [F.lit("/para"), p.cast("string")]))

    # The words that lead to one place.
    ways = {"前条": path(article - 1), "次条": path(article + 1), "同条": path(article), "本条": path(article), "前項": path(article, paragraph - 1), "次項": path(article, paragraph + 1), "同項": here}
    out = F.lit(None).cast("string")
    for name, way in ways.items():
        out = F.when(word == name, way).otherwise(out)
    return F.when(here.rlike("^art[0-9]+"), out)


def cited_paths(article: Column, branch: Column, paragraph: Column, item: Column) -> Column:
    """struct<path, alternates> of a citation by numbers, null where it names none: an item without a paragraph is one of the first; so may be the article itself."""
    base = F.concat(F.lit("art"), article.cast("string"), F.coalesce(F.concat(F.lit("-"), branch.cast("string")), F.lit("")))
    para, last = F.coalesce(F.concat(F.lit("/para"), paragraph.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("/item"), item.cast("string")), F.lit(""))
    first = F.concat(base, F.lit("/para1"))
    lone = item.isNotNull() & paragraph.isNull()
    path = F.when(lone, F.concat(first, last)).otherwise(F.concat(base, para, last))
    others = F.when(lone, F.array(F.concat(base, last))).when(paragraph.isNull(), F.array(first)).otherwise(F.array().cast("array<string>"))
    return F.struct(path.alias("path"), others.alias("alternates"))


def names_of(laws: DataFrame, aliases: DataFrame) -> DataFrame:
    """name and id of laws (id, name, short), one row for each name: an alias (name, id) goes before a short name, that before a name; of equals the smallest id."""
    ranked = aliases.select("name", "id", F.lit(0).alias("rank")).unionByName(laws.select(F.col("short").alias("name"), "id", F.lit(1).alias("rank"))).unionByName(laws.select("name", "id", F.lit(2).alias("rank")))
    return ranked.filter("name is not null").groupBy("name").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))
