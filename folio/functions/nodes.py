"""Laws in XML as nodes with keys that last: a key follows from the official numbers above a node, not from its place.

A pull parser gives each node's own facts (its tag, the texts right below it, the node around) on Arrow batches; official numbers, fingerprints and
checksums are Spark's work. Nodes of one law stay together as the parser gives them: a pass over them in that order puts their keys together, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import numerals, scan

# Elements that are nodes and their levels; elements with numbers and titles, which are no body; readings, which are no text.
LEVELS = {
    "Chapter": "chapter", "Section": "section", "Subsection": "subsection", "Article": "article", "Paragraph": "paragraph", "Item": "item", "Subitem1": "subitem1", "Subitem2": "subitem2", "Subitem3": "subitem3",
    "Column": "column", "TableStruct": "table_struct", "Table": "table", "AppdxTable": "appdx_table", "TableRow": "table_row", "TableColumn": "table_column", "SupplProvision": "suppl_provision",
}
NOT_BODY = {"ArticleTitle", "ArticleCaption", "ParagraphNum", "ItemTitle", "Subitem1Title", "Subitem2Title", "Subitem3Title", "ChapterTitle", "SectionTitle", "SubsectionTitle", "AppdxTableTitle", "SupplProvisionLabel"}
READINGS = {"Rt", "Rp"}
SECTIONS = {"MainProvision": "main", "SupplProvision": "supplementary", "AppdxTable": "appendix"}
#: Where a node says its number, and where its title.
SAID = {tag: {"Article": "ArticleTitle", "Paragraph": "ParagraphNum"}.get(tag, f"{tag}Title") for tag in LEVELS}
TITLES = {tag: f"{tag}Title" for tag in ("Chapter", "Section", "Subsection")} | {"SupplProvision": "SupplProvisionLabel"}
#: Levels of which equal siblings are no fault.
MAY_REPEAT = ("table_row", "table_column", "column")
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


#: Tags that are more to the parser than a part of the text around them.
_TOLD = {"Law", *SECTIONS, *LEVELS, *READINGS}


def _pulled(xml: str) -> tuple[dict[str, str], list[tuple]]:
    """The law's attributes and its nodes as a pull parser meets them: of each its tag, the index of the node around, section, number, place, supplementary provisions begun, the law that amends and the pieces of its text by tag."""
    nodes: list[tuple] = []
    opened: list[tuple] = [(None, None, None)]  # the node around or at an element, the piece of its text that grows, its section
    law: dict[str, str] = {}
    places: dict[int | str, int] = {}  # of the last node below a node, or at the top of a section
    supplements = 0

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal law, supplements
        around = opened[-1]
        index, piece, section = around
        if tag not in _TOLD:
            if index is not None and piece is None:
                piece = []
                nodes[index][-1].append((tag, piece))
                around = index, piece, section
            opened.append(around)
            return
        if tag == "Law":
            law = attributes
        section = section or SECTIONS.get(tag)
        if section and tag in LEVELS:
            supplements += tag == "SupplProvision"
            above = section if index is None else index
            places[above] = place = places.get(above, 0) + 1
            nodes.append((tag, index, section, attributes.get("Num"), place, supplements, attributes.get("AmendLawNum"), []))
            index, piece = len(nodes) - 1, None
        elif tag in READINGS:
            piece = []  # goes nowhere
        elif index is not None and piece is None:
            piece = []
            nodes[index][-1].append((tag, piece))
        opened.append((index, piece, section))

    def data(text: str) -> None:
        piece = opened[-1][1]
        if piece is not None:
            piece.append(text)

    def end(tag: str) -> None:
        del opened[-1]

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(xml, True)
    return law, nodes


def _composed(s: str | None) -> str | None:
    """Compatibility composition; None where it changes nothing."""
    return None if s is None or s.isascii() or unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)


_FACTS = "source_index int, parent_index int, level string, section string, num string, said string, title string, caption string, text string, body string, sort_order int, supplement int, origin string, composed_title string, composed_caption string, composed_text string, error string"


def _parse(xml: str | None) -> list[tuple]:
    """The facts of each node of a law, in order, or its one error."""
    if xml is None:
        return []
    try:
        law, pulled = _pulled(xml)
    except expat.ExpatError as broken:
        return [(None,) * 10 + (0,) + (None,) * 5 + (str(broken),)]
    source = "-".join(law.get(k) or "unknown" for k in ("Era", "Year", "PromulgateMonth", "PromulgateDay"))
    facts = []
    for index, (tag, above, section, num, place, supplement, amend, pieces) in enumerate(pulled):
        texts = [(k, v[0] if len(v) == 1 else "".join(v)) for k, v in pieces]
        first = dict(reversed(texts)).get  # of a name's texts
        text = "\n".join([t for _, t in texts if t]).strip() or None
        body = "\n".join([t for k, t in texts if t and k not in NOT_BODY]).strip() or None
        said = (first(SAID[tag]) or "").strip() or None
        title = (first(TITLES[tag]) or "").strip() or None if tag in TITLES else None
        caption = (first("ArticleCaption") or "").strip() or None
        origin = (amend or f"promulgated:{source}") if tag == "SupplProvision" else None
        facts.append((index, above, LEVELS[tag], section, num, said, title, caption, text, body, place, supplement, origin, _composed(title or said), _composed(caption), _composed(text), None))
    return facts


@lru_cache(65_536)
def _key_value(segment: str) -> str:
    return _SPACE.sub("", _composed(segment) or segment).replace("/", "%2F")


_KEYS = "durable_key string, legacy_key string, duplicate boolean"


def _keys(indexes, parents, sections, levels, segments, places):
    """Keys of the nodes of one law, in order, and whether a sibling that should differ is equal."""
    if indexes == [None]:
        return [None], [None], [False]
    if indexes != list(range(len(indexes))):
        raise ValueError(f"nodes of a law are not together and in order: {indexes[:20]}")
    # what is equal among siblings: those at the top are siblings by section
    own = [(section if parent is None else parent, _key_value(segment)) for section, parent, segment in zip(sections, parents, segments)]
    equals = Counter(own)
    nth: Counter = Counter()
    durable, legacy, duplicate = [], [], []
    for key, parent, section, level, place in zip(own, parents, sections, levels, places):
        segment, several = key[1], equals[key] > 1
        if several:
            nth[key] += 1
            segment = f"{segment}/occurrence:{nth[key]}"
        durable.append(f"{section if parent is None else durable[parent]}/{segment}")
        legacy.append(f"{'root' if parent is None else legacy[parent]}/{place}")
        duplicate.append(several and level not in MAY_REPEAT)
    return durable, legacy, duplicate


def _plain(composed: Column, c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(composed, c, F.lit("")), r"\s+", " "))


def _checksum(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON, keys in order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])).cast("binary"), 256)


def parsed(raw: DataFrame, says: tuple[str, ...] = ("number", "title", "caption", "text")) -> DataFrame:
    """doc_id and the nodes of each law (doc_id, unique, xml): source_index, parent_index, level, durable_key, legacy_key, content_checksum, body_checksum, number, title, caption, text, sort_order, duplicate and error.

    A durable key is the section and, for each node from the top, its level and official number, or a fingerprint of what it says; of siblings
    that agree in that each has its occurrence behind it, and duplicate tells those that should not. A legacy key has the places too.
    A text that can't be read is one row with error. says: those of number, title, caption and text that are wanted.
    """
    facts = scan.scanned(raw, ["xml"], ["doc_id"], _parse, _FACTS)
    level, said, num = F.col("level"), F.col("said"), F.col("num")
    article = F.coalesce(F.replace(F.nullif(F.regexp_extract(said, "(?s)第(.+)$", 1), F.lit("")), F.lit("条"), F.lit("")), num)
    plain = numerals.article_number(F.replace(num, F.lit("_"), F.lit("の")))
    number = F.when(level == "article", numerals.article_number(F.when(F.col("section") == "supplementary", F.concat(F.lit("附則"), "supplement", F.lit("_"), article)).otherwise(article))).when(level.isin("paragraph", "item") | level.startswith("subitem"), said)
    official = (
        F.when(level == "article", numerals.article_number(F.replace(article, F.lit("_"), F.lit("の")))).when(level.isin("paragraph", "item") | level.startswith("subitem"), F.coalesce(said, plain))
        .when(level == "suppl_provision", F.col("origin")).when(~level.isin("table_row", "table_column"), num)
    )
    facts = facts.withColumn("official", F.nullif(official, F.lit("")))
    semantic = {"title": F.coalesce("title", said), "caption": F.col("caption"), "text": F.col("text")}
    # only nodes without a number go by what they say
    print_of = _checksum(level=level, num=F.coalesce(num, F.lit("")), **{k: _plain(F.col(f"composed_{k}"), c) for k, c in semantic.items()})
    segment = F.concat(level, F.lit(":"), F.coalesce("official", F.concat(F.lit("fingerprint:"), print_of)))
    place = F.concat(level, F.lit(":"), F.coalesce("number", F.when(level.isin("column", "table_row", "table_column"), num), F.col("sort_order").cast("string")), F.lit("@"), "sort_order")
    content = _checksum(level=level, number=F.col("number"), title=F.col("title"), caption=F.col("caption"), text=F.col("text"))
    body = _checksum(level=level, title=F.col("title"), caption=F.col("caption"), body=F.col("body"))
    facts = facts.withColumn("number", number).withColumns({"segment": segment, "place": place, "content_checksum": content, "body_checksum": body})
    carried = ["doc_id", "source_index", "parent_index", "level", "content_checksum", "body_checksum", *says, "sort_order", "error"]
    # the nodes of a law come from the parser together and in order: they need no shuffle to meet
    rows = scan.together(facts, "source_index", ["source_index", "parent_index", "section", "level", "segment", "place"], carried, _keys, _KEYS)
    return rows.select("doc_id", "source_index", "parent_index", "level", "durable_key", "legacy_key", "content_checksum", "body_checksum", *says, "sort_order", "duplicate", "error")
