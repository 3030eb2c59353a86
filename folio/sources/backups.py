"""Backups of many kinds of records in one JSON envelope, taken in by one pass over VARIANT values.

An envelope that can't be read is put aside whole; of the others every section's items, and the items within these,
become rows with what they refer to. References are looked up once each, whatever the sections that name them, and what is taken in
follows from them in the sections' order: an item within needs its parent, a reference has to be known, a key counts once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Section(NamedTuple):
    """path in the envelope; inner and inner_path of items within; refers: paths of the objects that name an article; needs: a text that has to be there, by the first path that has one; one_of: values that it may have; unique: whether a reference (with that text) counts once for a parent."""

    name: str
    path: str
    inner: str | None = None
    inner_path: str | None = None
    refers: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    one_of: tuple[str, ...] = ()
    unique: bool = False
    inner_unique: bool = False


# The sections of a backup, and what each item has to have.
SECTIONS = (
    Section("practiceTopics", "$.practiceTopics", "articlePracticeTopics", "$.articleRefs", needs=("$.slug", "$.name"), inner_unique=True),
    Section("drawingNoteTemplates", "$.drawingNoteTemplates", refers=("$",)),
    Section("packs", "$.packs", "packItems", "$.items", inner_unique=True),
    Section("projects", "$.projects", "checkItems", "$.checkItems"),
    Section("highlights", "$.highlights", refers=("$",)),
    Section("tags", "$.tags", refers=("$",), needs=("$.tagName",), unique=True),
    Section("activities", "$.activities", needs=("$.type",), one_of=("search", "view", "export", "import")),
    Section("articleCooccurrences", "$.articleCooccurrences", refers=("$.source", "$.related")),
)


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "struct<>").isNotNull()  # the schema would be made of all that is within


def _items(v: Column, path: str) -> Column:
    """The objects of a list; nothing where there is none."""
    found = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(found, _is_object)


def _text(v: Column, path: str) -> Column:
    """A text at path; null for any other kind of value."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _refs(v: Column, paths: tuple[str, ...]) -> Column:
    one = [F.struct(_text(v, f"{p}.lawId").alias("law"), _text(v, f"{p}.articleNumberNormalized").alias("number")) for p in paths]
    return F.array(*one) if one else F.array().cast("array<struct<law: string, number: string>>")


def _by_section(values: dict[str, Column], rest: Column) -> Column:
    out = rest
    for name, value in values.items():
        out = F.when(F.col("section") == name, value).otherwise(out)
    return out


def laid_out(envelopes: DataFrame) -> DataFrame:
    """envelope, section, place (its number in the section), parent (its parent's place, null for an outer item), says (the text that it needs), refs and item of each item of the envelopes (id, json).

    An envelope that can't be read is one row of section envelope. Items are rows before anything is read from them.
    """
    read = envelopes.select(F.col("id").alias("envelope"), F.try_parse_json("json").alias("v"))
    lists = F.array(*[F.struct(F.lit(s.name).alias("section"), _items(F.col("v"), s.path).alias("items")) for s in SECTIONS])
    broken = F.array(F.struct(F.lit("envelope").alias("section"), F.array("v").alias("items")))
    outer = read.select("envelope", F.inline(F.when(_is_object(F.col("v")), lists).otherwise(broken))).select("envelope", "section", F.posexplode("items").alias("place", "item"))

    def row(section: Column, place: Column, parent: Column, item: Column) -> Column:
        return F.struct(section.alias("section"), place.cast("int").alias("place"), parent.cast("int").alias("parent"), item.alias("item"))

    def inside(s: Section) -> Column:
        return F.transform(_items(F.col("item"), s.inner_path), lambda y, j: row(F.lit(s.inner), j, F.col("place"), y))

    own = F.array(row(F.col("section"), F.col("place"), F.lit(None), F.col("item")))
    rows = outer.select("envelope", F.inline(_by_section({s.name: F.concat(own, inside(s)) for s in SECTIONS if s.inner}, own)))
    item, none = F.col("item"), F.lit(None).cast("string")
    says = _by_section({s.name: F.coalesce(*[_text(item, p) for p in s.needs]) for s in SECTIONS if s.needs}, none)
    refs = _by_section({s.name: _refs(item, s.refers) for s in SECTIONS if s.refers} | {s.inner: _refs(item, ("$",)) for s in SECTIONS if s.inner}, _refs(item, ()))
    return rows.select("envelope", "section", "place", "parent", says.alias("says"), refs.alias("refs"), "item")


def references(items: DataFrame) -> DataFrame:
    """law and number of each article that the items name, once each."""
    return items.select(F.inline("refs")).filter("law is not null and number is not null").distinct()


def judged(items: DataFrame, articles: DataFrame) -> DataFrame:
    """items (written, with a column key that tells them apart) with targets (of their references, in order) and outcome.

    articles: law and number (unique together) and target. Outcomes: imported, UNREADABLE, NO_PARENT, UNKNOWN_REFERENCE, MISSING_TEXT, UNKNOWN_VALUE and DUPLICATE.
    """
    # an item names so many articles at most: each is looked up in its place, no list of them is put together again
    rows, most = items, max(len(s.refers) for s in SECTIONS)
    for i in range(most):
        none = F.lit(None).cast(items.schema["key"].dataType)
        known = articles.select(F.col("law").alias(f"_law{i}"), F.col("number").alias(f"_number{i}"), none.alias(f"_none{i}"), F.col("target").alias(f"_target{i}"))
        ref = F.get("refs", F.lit(i))
        # items that name nothing are dealt by their own keys
        named = F.when(ref["law"].isNull(), F.col("key")).eqNullSafe(F.col(f"_none{i}"))
        rows = rows.join(known, (ref["law"] == F.col(f"_law{i}")) & (ref["number"] == F.col(f"_number{i}")) & named, "left")
    rows = rows.withColumn("targets", F.slice(F.array(*[F.col(f"_target{i}") for i in range(most)]), F.lit(1), F.size("refs")))
    names = {s.name: s for s in SECTIONS}
    needs, listed, unique = ([n for n, s in names.items() if getattr(s, k)] for k in ("needs", "one_of", "unique"))
    unique += [s.inner for s in SECTIONS if s.inner_unique]
    odd = F.lit(False)
    for n in listed:
        odd = odd | ((F.col("section") == n) & ~F.col("says").isin(*names[n].one_of))
    reason = (
        F.when(F.col("section") == "envelope", "UNREADABLE").when(F.exists("targets", lambda t: t.isNull()), "UNKNOWN_REFERENCE")
        .when(F.col("section").isin(*needs) & (F.coalesce("says", F.lit("")) == ""), "MISSING_TEXT").when(odd, "UNKNOWN_VALUE")
    )
    rows = rows.withColumn("outcome", reason)
    # the parent's outcome: parents are outer items, so one look is enough
    inner = {s.inner: s.name for s in SECTIONS if s.inner}
    above = F.lit(None).cast("string")
    for child, parent in inner.items():
        above = F.when(F.col("section") == child, parent).otherwise(above)
    lost = rows.filter("outcome is not null").select("envelope", F.col("section").alias("above"), F.col("place").alias("parent"), F.lit(True).alias("lost")).filter(F.col("above").isin(*inner.values()))
    rows = rows.withColumn("above", above).join(lost, ["envelope", "above", "parent"], "left")
    rows = rows.withColumn("outcome", F.when(F.col("lost"), "NO_PARENT").otherwise(F.col("outcome")))
    # of one key in one parent the first counts; the rows of one envelope, dealt as for the look at parents
    first = Window.partitionBy("envelope", "above", "parent", "section", "targets", "says", F.col("outcome").isNull()).orderBy("place")
    again = F.col("section").isin(*unique) & F.col("outcome").isNull() & (F.row_number().over(first) > 1)
    return rows.withColumn("outcome", F.when(again, "DUPLICATE").otherwise(F.coalesce("outcome", F.lit("imported")))).select(*items.columns, "targets", "outcome")


def values(items: DataFrame, section: str, fields: dict[str, str]) -> DataFrame:
    """key and typed fields (name -> type) of a section's imported items; a value of another type is null."""
    own = items.filter((F.col("section") == section) & (F.col("outcome") == "imported"))
    return own.select("key", "envelope", "place", "parent", "targets", *[F.try_variant_get("item", f"$.{name}", kind).alias(name) for name, kind in fields.items()])
