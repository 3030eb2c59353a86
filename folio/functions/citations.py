"""Citations in running text: which law, which provision, and how far that can be trusted.

Names of laws are found by an automaton over all names of a catalogue (of names within names the longest), so a text is read once whatever
their number; without a catalogue by the form that such names have. What a citation names is told by what stands before it: a law's name at most
REACH characters back, an abbreviation right before it, else the law that the text is of.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import numerals, scan

#: Characters between a law's name and a citation of it, at most.
REACH = 40
#: Names that a task's automaton holds at most; a catalogue has some ten thousand.
MAX_NAMES = 200_000
# Abbreviations in the order in which they are tried, relative words, eras and ministries of notices, forms of names.
ABBREVIATIONS = ("法", "令", "規則", "この法律", "この政令", "この省令")
RELATIVE = ("前条", "次条", "同条", "本条", "前項", "次項", "同項", "前号", "次号", "同号", "前二項", "前三項", "前各項", "前各号")
ERAS = ("明治", "大正", "昭和", "平成", "令和")
MINISTRIES = ("建設省", "国土交通省", "運輸省")
NAME_ENDS = ("法", "法律", "政令", "省令", "規則", "条例")

_NUM = "(?:[〇一二三四五六七八九十百千]+|[0-9]+)"
_EXPLICIT = re.compile(f"第({_NUM})条(?:の({_NUM}))?(?:第({_NUM})項)?(?:第({_NUM})号)?")
_RELATIVE = re.compile("|".join(RELATIVE))
_NOTICE = re.compile(f"({'|'.join(ERAS)})({_NUM})年({'|'.join(MINISTRIES)})告示第({_NUM})号")
_NAME = re.compile(rf"([^\s、。（）「」]{{2,30}}?(?:{'|'.join(NAME_ENDS)}))(?:（[^）]*）)?")
_ASIDE = re.compile("（[^）]*）")


class Names:
    """The names of a catalogue in a text: leftmost, of those that begin together the longest, none within another; what stands in brackets behind one belongs to it."""

    def __init__(self, names: dict[str, str]) -> None:
        self.names, self.automaton = names, None

    def __reduce__(self):
        return Names, (self.names,)

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and law of all names, by start, the longest first."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for name, law in self.names.items():
                self.automaton.add_word(name, (len(name), law))
            self.automaton.make_automaton()
        found = sorted((end + 1 - n, -(end + 1), law) for end, (n, law) in self.automaton.iter(text)) if self.names else []
        return [(start, -end, law) for start, end, law in found]

    def found(self, text: str) -> list[tuple[int, int, str]]:
        """Those that count, by start."""
        out, at = [], 0
        for start, end, law in self.hits(text):
            if start >= at:
                at = end
                out.append((start, end, law))
        return out


def _named(text: str, names: Names | None) -> list[tuple[int, str]]:
    """Where each name (with its brackets) ends, and its law."""
    if names is None:
        return [(m.end(), m[1]) for m in _NAME.finditer(text)]
    out = []
    for _, end, law in names.found(text):
        aside = _ASIDE.match(text, end)
        out.append((aside.end() if aside else end, law))
    return out


_FOUND = "start int, end int, raw string, kind string, law string, article string, branch string, paragraph string, item string"


def _scan(names: Names | None):
    def scan_text(text: str | None, law: str | None):
        if not text:
            return
        ends, laws = zip(*named) if (named := _named(text, names)) else ((), ())
        rows = []
        for m in _EXPLICIT.finditer(text):
            last = bisect_right(ends, m.start()) - 1
            if last >= 0 and m.start() - ends[last] <= REACH:
                kind, whose = "named", laws[last]
            else:
                short = next((a for a in ABBREVIATIONS if text.endswith(a, 0, m.start())), None)
                kind, whose = ("abbreviated", f"@{short}") if short else ("plain", law)
            rows.append((*m.span(), m[0], kind, whose, *m.groups()))
        rows += [(*m.span(), m[0], "relative", law, None, None, None, None) for m in _RELATIVE.finditer(text)]
        # of a notice, era, year, ministry and number
        rows += [(*m.span(), m[0], "notice", None, *m.groups()) for m in _NOTICE.finditer(text)]
        yield from sorted(rows, key=lambda r: r[0])

    return scan_text


def _relative_path(word: Column, here: Column) -> Column:
    """Where a relative word leads from a path (art5-2/para3/item1); null for ranges and outside articles."""
    article = F.regexp_extract(here, "^art([0-9]+)", 1).try_cast("long")
    paragraph = F.regexp_extract(here, "para([0-9]+)", 1).try_cast("long")
    steps = {"前条": -1, "次条": 1, "同条": 0, "本条": 0}
    out = F.when(word == "同項", here)
    for name, step in steps.items():
        out = F.when(word == name, F.concat(F.lit("art"), (article + step).cast("string"))).otherwise(out)
    for name, step in {"前項": -1, "次項": 1}.items():
        out = F.when(word == name, F.concat(F.lit("art"), article.cast("string"), F.lit("/para"), (paragraph + step).cast("string"))).otherwise(out)
    return F.when(here.rlike("^art[0-9]+"), out)


def resolved(texts: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id, start, end (code points), raw, law, path, alternates, method and confidence of each citation in texts (id, text, law, here), from left to right.

    names: name (unique) and id of laws; without it a law is called by its name. law and here: the law that a text is of and its
    own path, for citations that name none; both may be null. A citation without a paragraph may mean the first.
    """
    known = None
    if names is not None:
        rows = names.filter("name is not null and name <> ''").limit(MAX_NAMES + 1).collect()
        if len(rows) > MAX_NAMES:
            raise ValueError(f"a catalogue has at most {MAX_NAMES} names")
        known = Names({r.name: r.id for r in rows})
    found = scan.scanned(texts, ["text", "law"], ["id", "here"], _scan(known), _FOUND)
    part = {c: F.concat(F.lit(name), numerals.citation_number(F.col(c)).cast("string")) for c, name in (("article", "art"), ("branch", "-"), ("paragraph", "/para"), ("item", "/item"))}
    empty = F.lit("")
    base = F.concat(part["article"], F.coalesce(part["branch"], empty))
    lone = F.col("item").isNotNull() & F.col("paragraph").isNull()
    path = F.when(lone, F.concat(base, F.lit("/para1"), part["item"])).otherwise(F.concat(base, F.coalesce(part["paragraph"], empty), F.coalesce(part["item"], empty)))
    other = F.when(lone, F.concat(base, part["item"])).when(F.col("paragraph").isNull(), F.concat(base, F.lit("/para1")))
    provision = F.col("kind").isin("named", "abbreviated", "plain")
    notice = F.concat("article", numerals.citation_number(F.col("branch")).cast("string"), F.lit("年"), "paragraph", F.lit("告示第"), numerals.citation_number(F.col("item")).cast("string"), F.lit("号"))
    trust = F.when(F.col("kind") == "named", 0.95).when(F.col("kind") == "abbreviated", 0.8).when(F.col("kind") == "plain", 0.7).when(F.col("kind") == "notice", 0.9)
    return found.select(
        "id", "start", "end", "raw", F.when(F.col("kind") == "notice", notice).otherwise(F.col("law")).alias("law"),
        F.when(provision, path).when(F.col("kind") == "relative", _relative_path(F.col("raw"), F.col("here"))).alias("path"),
        F.when(provision & other.isNotNull(), F.array(other)).otherwise(F.array().cast("array<string>")).alias("alternates"),
        F.when(F.col("kind") == "relative", "RELATIVE").when(F.col("kind") == "abbreviated", "ABBREVIATED").otherwise("EXPLICIT").alias("method"),
        F.coalesce(trust, F.when(F.col("here").isNotNull(), 0.75).otherwise(0.3)).alias("confidence"),
    )


_ONE = r"(?:[一二三四五六七八九十百千]+|[0-9]+|[０-９]+)"
_BRANCH = rf"({_ONE}(?:の{_ONE})?)"
_AFTER_NAME = re.compile(rf"の?第{_BRANCH}条(?:\s*第{_BRANCH}項)?(?:\s*第{_BRANCH}号)?")
# Links without a name, in order of priority.
_LINKS = (
    ("previous", re.compile(rf"前条(?:\s*第{_BRANCH}項)?")), ("appendix", re.compile(f"別表第{_BRANCH}")),
    ("paragraph", re.compile(rf"(?<!\S)第{_BRANCH}項(?!\s*第)")), ("same", re.compile("同条()")),
)
_LINK = "start int, end int, text string, kind string, law string, number string, paragraph string"


def _scan_links(names: Names):
    def scan_text(text: str | None):
        if not text:
            return
        rows, claimed = [], bytearray(len(text))
        at = 0
        for start, end, law in names.hits(text):
            m = _AFTER_NAME.match(text, end)
            if m and start >= at:
                at = m.end()
                rows.append((start, at, text[start:at], "law", law, m[1], m[2]))
        for row in rows:
            claimed[row[0] : row[1]] = b"\1" * (row[1] - row[0])
        for kind, form in _LINKS:
            for m in form.finditer(text):
                if not any(claimed[m.start() : m.end()]):
                    claimed[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                    rows.append((*m.span(), m[0], kind, None, m[1] or None, None))
        yield from sorted(rows, key=lambda r: r[0])

    return scan_text


def linked(articles: DataFrame, names: DataFrame) -> DataFrame:
    """id, start, end, text, kind, target_law, number and target of each link in articles (id, law, parent, level, number, place, text), from left to right.

    names: name (unique) and id of laws. Kinds: law (an article or paragraph of a named law), previous (the article before, among its siblings), appendix,
    paragraph (of the article that the text is in) and same (the text's parent). A target that does not exist is null. Levels are article and paragraph.
    """
    rows = names.filter("name is not null and name <> ''").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"a catalogue has at most {MAX_NAMES} names")
    known = Names({r.name: r.id for r in rows})
    found = scan.scanned(articles, ["text"], ["id", "parent", "level"], _scan_links(known), _LINK)
    found = found.withColumn("number", numerals.article_number(F.col("number"))).withColumn("paragraph", numerals.article_number(F.col("paragraph")))
    own = F.when(F.col("level") == "article", F.col("id")).otherwise(F.col("parent"))
    found = found.withColumn("own", own)
    heads = articles.filter("level = 'article'")
    by_number = heads.groupBy("law", "number").agg(F.max("id").alias("article"))
    by_paragraph = articles.filter("level = 'paragraph'").groupBy(F.col("parent").alias("article"), F.col("number").alias("paragraph")).agg(F.max("id").alias("below"))
    siblings = Window.partitionBy("law", "parent").orderBy("place", "own")
    before = heads.select(F.col("id").alias("own"), "law", F.coalesce("parent", F.lit("root")).alias("parent"), "place")
    before = before.select("own", F.lag("own").over(siblings).alias("before"))
    out = found.join(by_number, ["law", "number"], "left")
    # a paragraph of the named law's article, or of the article around
    whose = F.when(F.col("kind") == "law", F.col("article")).when(F.col("kind") == "paragraph", F.col("own"))
    out = out.withColumn("article", whose).withColumn("paragraph", F.when(F.col("kind") == "paragraph", F.col("number")).otherwise(F.col("paragraph")))
    out = out.join(by_paragraph, ["article", "paragraph"], "left").join(before, "own", "left")
    target = F.when(F.col("kind") == "law", F.coalesce("below", "article")).when(F.col("kind") == "previous", F.col("before")).when(F.col("kind") == "paragraph", F.col("below")).when(F.col("kind") == "same", F.col("parent"))
    number = F.when(F.col("kind") == "law", F.concat_ws("_", "number", "paragraph")).when(F.col("kind").isin("previous", "same"), F.col("text")).otherwise(F.col("number"))
    return out.select("id", "start", "end", "text", "kind", F.col("law").alias("target_law"), number.alias("number"), target.alias("target"))
