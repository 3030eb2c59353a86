"""Semi-structured documents as addressed segments, in document order."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import scan
from folio.functions.text import appendix_slug, fingerprint, kanji_value

# Elements that hold numbered text, with the step of a path that each gives.
LEVELS = {"Part": "part", "Chapter": "chap", "Section": "sec", "Subsection": "subsec", "Division": "div", "Article": "art", "Paragraph": "para", "Item": "item"} | {f"Subitem{i}": "sub" for i in range(1, 11)}
HEADINGS = ("Part", "Chapter", "Section", "Subsection", "Division")
SUPPLEMENT = "SupplProvision"
APPENDICES = ("AppdxTable", "AppdxStyle", "AppdxNote", "AppdxFormat", "AppdxFig", "Appdx", "SupplProvisionAppdxTable", "SupplProvisionAppdxStyle", "SupplProvisionAppdx")
TITLES = {f"{x}Title" for x in (*LEVELS, *APPENDICES)}
NOT_BODY = TITLES | {"ArticleCaption", "ArticleTitle", "ParagraphNum", "ItemTitle", "Subitem1Title", "ChapterTitle", "SectionTitle", "AppdxTableTitle", "SupplProvisionLabel", "Rt"}


#: What a tag is to the parser; a title's frame is told from others by its own kind.
_PLAIN, _NO_BODY, _TITLE, _LEVEL, _APPENDIX, _SUPPLEMENT = range(6)
_KINDS = {tag: _NO_BODY for tag in NOT_BODY} | {tag: _TITLE for tag in (*TITLES, "ArticleCaption")} | {tag: _LEVEL for tag in LEVELS} | {tag: _APPENDIX for tag in APPENDICES} | {SUPPLEMENT: _SUPPLEMENT}
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


@lru_cache(65_536)
def _named(num: str) -> str:
    """The numbers of an attribute, joined by hyphens; empty for none."""
    return "-".join(str(n) for x in re.split(r"[_:の]", unicodedata.normalize("NFKC", num)) if (n := kanji_value(x)) is not None)


def _pulled(xml: str) -> list[list]:
    """Numbered elements of an XML text as a pull parser meets them, no tree of it in memory: of each its tag, the row around it, its step, pieces of its body, heading, title, whether it is told, and whether a child has given heading and title."""
    rows: list[list] = []
    # an open element: kind, tag, row (its own, if told, or that of what is around), told, bodies that its text goes to, numbers of children by tag
    opened: list[tuple] = [(_PLAIN, "", None, False, (), {})]
    supplements = appendices = 0
    fresh = False  # whether the element is a title no child of which has begun
    kind_of = _KINDS.get

    def start(tag: str, attributes: dict[str, str]) -> None:
        nonlocal supplements, appendices, fresh
        kind = kind_of(tag, _PLAIN)
        fresh = kind == _TITLE
        _, _, row, _, bodies, places = opened[-1]
        if kind == _PLAIN:
            opened.append((kind, tag, row, False, bodies, {}))
        elif kind <= _TITLE:
            opened.append((kind, tag, row, False, (), {}))
        elif kind == _SUPPLEMENT:
            supplements += 1
            # the step of all below it; no row of its own
            rows.append([tag, None, f"suppl:{attributes.get('AmendLawNum') or supplements}", [], None, None, False, False, False])
            opened.append((kind, tag, len(rows) - 1, False, bodies, {}))
        else:
            own: list[str] = []
            if kind == _APPENDIX:
                appendices += 1
                step, bodies = str(appendices), (own, *bodies)
            else:
                places[tag] = place = places.get(tag, 0) + 1
                step, bodies = None if tag in HEADINGS else LEVELS[tag] + (_named(attributes.get("Num") or "") or str(place)), (own,)
            opened.append((kind, tag, len(rows), True, bodies, {}))
            rows.append([tag, row, step, own, None, None, True, False, False])

    def data(text: str) -> None:
        kind, tag, _, _, bodies, _ = opened[-1]
        for body in bodies:
            body.append(text)
        if fresh:
            _, _, row, told, _, _ = opened[-2]
            if told:
                row = rows[row]
                if not row[7]:
                    row[4] = (row[4] or "") + text
                if not row[8] and tag in TITLES:
                    row[5] = (row[5] or "") + text

    def end(tag: str) -> None:
        nonlocal fresh
        if opened.pop()[0] == _TITLE:
            fresh = False
            _, _, row, told, _, _ = opened[-1]
            if told:
                rows[row][7] = True
                rows[row][8] |= tag in TITLES

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.Parse(xml, True)
    return rows


def _spaced(body: str) -> str:
    """A text after compatibility composition, with single spaces and none around it."""
    if body.isascii():
        return " ".join(body.split())
    return _SPACE.sub(" ", unicodedata.normalize("NFKC", body)).strip(" ")


def _segments(xml: str | None):
    """A row for each numbered element of an XML text, in document order; one row with error if it can't be read."""
    if xml is None:
        return ()
    try:
        rows = _pulled(xml)
    except expat.ExpatError as broken:
        return [(None, None, None, None, 0, str(broken), "", None)]
    # an appendix's title is known by now
    slugs: dict[str, int] = {}
    paths: list[str] = []
    numbers: list[int | None] = []
    out, n = [], 0
    for tag, row, step, pieces, heading, title, told, _, _ in rows:
        around = path = paths[row] if row is not None else ""
        if _KINDS[tag] == _APPENDIX:
            step = f"appdx-{appendix_slug(tag.removeprefix(SUPPLEMENT), title or '') or step}"
            path = f"{path}/{step}" if path else step
            slugs[path] = k = slugs.get(path, 0) + 1
            path += f"-{k}" if k > 1 else ""
        elif step:
            path = f"{path}/{step}" if path else step
        paths.append(path)
        if not told:
            numbers.append(None)
            continue
        n += 1
        numbers.append(n)
        parent = None
        if row is not None and path:
            # the nearest around it with the path up to the last step
            last = path.rpartition("/")[0]
            if last == around and last:
                parent = numbers[row]
            if parent is None and last:
                while row is not None and (paths[row] != last or numbers[row] is None):
                    row = rows[row][1]
                parent = numbers[row] if row is not None else None
        body = "".join(pieces).strip()
        out.append((path, tag, heading, body, n, None, _spaced(body), parent))
    return out


def segmented(raw: DataFrame) -> DataFrame:
    """doc_id and its segments with normalised body, fingerprint and the sequence of the segment around each (above). raw: doc_id, xml."""
    rows = scan.scanned(raw, ["xml"], ["doc_id"], _segments, "path string, level string, heading string, body string, sequence int, error string, body_normalized string, above int")
    return rows.withColumn("fingerprint", fingerprint(F.col("body_normalized")))


def leftover(path: Column) -> Column:
    """Whether the last step of a path has a number in words, which should be in digits."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "^(?:art|para|item)", "").rlike("[〇一二三四五六七八九]")


def checked(segments: DataFrame) -> DataFrame:
    """code, node and n: segments with an empty body and with numbers left in words, by level; fingerprints and paths that stand twice in a law. Segments are read once."""
    empty = F.col("body_normalized") == ""

    def told(code, node, key):
        return F.struct(F.lit(code).alias("code"), node.alias("node"), key.cast("string").alias("key"))

    found = F.array(
        told("DUPLICATE_PATH", F.lit("path"), F.col("path")), F.when(~empty, told("DUPLICATE_ANCHOR", F.lit("fingerprint"), F.col("fingerprint"))),
        F.when(empty, told("EMPTY_BODY", F.col("level"), F.lit(None))), F.when(leftover(F.col("path")), told("LEFTOVER_KANJI", F.col("level"), F.lit(None))),
    )
    counts = segments.select("doc_id", F.inline(F.array_compact(found))).groupBy("doc_id", "code", "node", "key").agg(F.count(F.lit(1)).alias("c"))
    n = F.when(F.startswith("code", F.lit("DUPLICATE")), (F.col("c") > 1).cast("long")).otherwise(F.col("c")).alias("n")
    none = segments.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("code"), F.lit(b).alias("node"), F.lit(0).cast("long").alias("n")) for a, b in (("DUPLICATE_ANCHOR", "fingerprint"), ("DUPLICATE_PATH", "path"))])))
    return counts.select("code", "node", n).unionByName(none).groupBy("code", "node").agg(F.sum("n").alias("n"))


def _captured(xml: str | None):
    """One row: characters other than white space in headings and bodies of the segments of an XML text; null without segments, 0 if it can't be read."""
    try:
        told = [(row[4] or "") + "".join(row[3]).strip() for row in _pulled(xml) if row[6]] if xml is not None else []
    except expat.ExpatError:
        told = [""]
    return [(sum(len(t) - sum(map(t.count, " \t\n\x0b\f\r")) for t in told) if told else None,)]


def extraction(raw: DataFrame) -> DataFrame:
    """doc_id, total, captured and rate: share of each document's characters that segments hold; tags are not counted. raw: doc_id, xml; each is read once."""
    total = F.length(F.regexp_replace(F.regexp_replace("xml", "<[^>]*>", ""), r"\s+", "")).alias("total")
    found = scan.scanned(raw.select("doc_id", "xml", total), ["xml"], ["doc_id", "total"], _captured, "captured long")
    return found.withColumn("rate", F.when(F.col("total") > 0, F.coalesce("captured", F.lit(0)) / F.col("total")))


def supplements(xml: Column) -> Column:
    """array<struct<amend, extract, label, title>>: the supplementary provisions of a law in XML that have a label, in order."""
    whole = F.regexp_extract_all(xml, F.lit(r"(?s)<SupplProvision(?:\s[^>]*)?>\s*<SupplProvisionLabel[^>]*>.*?</SupplProvisionLabel>"), F.lit(0))

    def one(x):
        amend = F.nullif(F.trim(F.regexp_extract(x, r'^<SupplProvision[^>]*\sAmendLawNum="([^"]*)"', 1)), F.lit(""))
        extract = F.regexp_extract(x, r'^<SupplProvision[^>]*\sExtract="([^"]*)"', 1) == "true"
        label = F.trim(F.regexp_extract(x, r"(?s)<SupplProvisionLabel[^>]*>(.*)</SupplProvisionLabel>", 1))
        title = F.when(amend.isNull(), "制定時附則").otherwise(F.concat(F.lit("附則（"), amend, F.when(extract, "・抄").otherwise(""), F.lit("）")))
        return F.struct(amend.alias("amend"), extract.alias("extract"), label.alias("label"), title.alias("title"))

    return F.filter(F.transform(whole, one), lambda s: s["label"] != "")


def cell_style(tag: Column) -> Column:
    """struct<top, right, bottom, left, colspan, rowspan> of the opening tag of a table's cell: borders solid or none, spans of 1 at least."""

    def attribute(name):
        return F.regexp_extract(tag, rf'\s{name}="([^"]*)"', 1)

    borders = [F.when(attribute(f"Border{side}") == "solid", "solid").otherwise("none").alias(side.lower()) for side in ("Top", "Right", "Bottom", "Left")]
    spans = [F.coalesce(F.greatest(F.lit(1), F.regexp_extract(attribute(name), r"^\s*([+-]?[0-9]{1,9})", 1).try_cast("int")), F.lit(1)).alias(name) for name in ("colspan", "rowspan")]
    return F.struct(*borders, *spans)
