"""Normalisation, fingerprints, numerals and anchors as Column expressions; Arrow functions where Spark has none."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Numerals of the texts.
DIGITS = "〇一二三四五六七八九"
TENS = {"十": 10, "百": 100, "千": 1000}
MYRIADS = {"万": 10**4, "億": 10**8}


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def collapsed(c: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def normal_body(c: Column) -> Column:
    return collapsed(nfkc(c))


def fingerprint(c: Column, n: int = 16) -> Column:
    """The first n hexadecimal digits of SHA-256."""
    return F.left(F.sha2(c.cast("binary"), 256), F.lit(n))


def quote_selector(c: Column, n: int = 32) -> dict[str, Column]:
    """The first n characters, and the last n of a longer text."""
    return {"prefix": F.left(c, F.lit(n)), "suffix": F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise("")}


def context_checksum(text: Column, start: Column, end: Column, around: int = 10) -> Column:
    """Fingerprint of a quote with around characters on each side, to see whether it still stands where it was."""
    before = F.substr(text, F.greatest(start - around, F.lit(0)) + 1, F.least(start, F.lit(around)))
    return fingerprint(F.concat(before, F.lit("⟦"), F.substr(text, start + 1, end - start), F.lit("⟧"), F.substr(text, end + 1, F.lit(around))), 64)


def share_of(c: Column, pattern: str) -> Column:
    """Share of characters that match a one-character pattern, 0 for an empty text."""
    return F.when(F.length(c) == 0, 0.0).otherwise(F.round(F.regexp_count(c, F.lit(pattern)) / F.length(c), 4))


def half_width(c: Column) -> Column:
    """Full-width digits and Latin letters as ASCII."""
    wide = "".join(chr(x + 0xFEE0) for x in range(0x21, 0x7F))
    return F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))))


def kanji_value(text: str | None) -> int | None:
    """Value of a numeral written with units or digit by digit; None for anything else."""
    if not text:
        return None
    text = unicodedata.normalize("NFKC", text).replace("零", "〇")
    if text.isdecimal():
        return int(text)
    if all(x in DIGITS for x in text):
        return int("".join(str(DIGITS.index(x)) for x in text))
    total = group = 0
    digit: int | None = None
    for x in text:
        if x in DIGITS:
            if digit is not None:
                return None
            digit = DIGITS.index(x)
        elif x in TENS:
            group += (1 if digit is None else digit) * TENS[x]
            digit = None
        elif x in MYRIADS:
            total += (group + (digit or 0)) * MYRIADS[x]
            group, digit = 0, None
        else:
            return None
    return total + group + (digit or 0)


@F.pandas_udf(StringType())
def digits_in_title(s: pd.Series) -> pd.Series:
    """A title with each of its numerals in digits."""
    return s.map(lambda x: _NUMERAL.sub(lambda m: str(kanji_value(m[0])), x), na_action="ignore")


@F.pandas_udf(StringType())
def fraction(s: pd.Series) -> pd.Series:
    """Parts of a whole (three parts' two) with a stroke, the whole's digits three and three; what is no fraction stays as it is."""

    def one(x: str) -> str:
        below, _, above = x.partition("分の")
        a, b = kanji_value(above), kanji_value(below)
        return x if a is None or b is None else f"{a}/{b:,}"

    return s.map(one, na_action="ignore")


def quantity(n: Column) -> Column:
    """A whole number with the names of its myriads, digits, three and three, between them; groups of nothing are left out."""
    n = n.cast("long")
    parts = [(F.floor(n / 10**8), "億"), (F.floor(n / 10**4) % 10**4, "万"), (n % 10**4, "")]
    text = F.concat(*[F.when(x > 0, F.concat(F.format_number(x.cast("long"), 0), F.lit(name))).otherwise("") for x, name in parts])
    return F.when(n == 0, "0").otherwise(text)


# Kinds of appendices, by the element's name.
APPENDICES = (("AppdxTable", "table"), ("AppdxStyle", "style"), ("AppdxNote", "note"), ("Appdx", "appdx"))


def appendix_slug(tag: str, title: str) -> str | None:
    """Kind and number of an appendix; None without either."""
    kind = next((slug for name, slug in APPENDICES if tag.startswith(name)), None)
    m = re.search("第(.+)$", title or "")
    parts = [kanji_value(x) for x in m[1].split("の")] if m else [None]
    return None if kind is None or None in parts else f"{kind}-{'-'.join(map(str, parts))}"


@F.pandas_udf(StringType())
def appendix_slugs(tag: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([appendix_slug(a, b) for a, b in zip(tag, title)], dtype=object)


def to_kanji(n: Column) -> Column:
    """1 to 9999 with units; null otherwise."""
    n = n.cast("int")
    names = F.array(*[F.lit(x) for x in ["", *DIGITS[1:]]])
    out = []
    for unit, name in ((1000, "千"), (100, "百"), (10, "十")):
        d = F.floor(n / unit) % 10
        out.append(F.when(d == 0, "").when(d == 1, name).otherwise(F.concat(F.get(names, d.cast("int")), F.lit(name))))
    return F.when(n.between(1, 9999), F.concat(*out, F.get(names, (n % 10).cast("int"))))


_NUMERAL = re.compile(r"[〇一二三四五六七八九十百千万億0-9０-９]+")


@F.pandas_udf(StringType())
def article_key(s: pd.Series) -> pd.Series:
    """A numbered heading with branches as digits joined by underscores."""
    return s.map(lambda x: None if x is None else "_".join(str(kanji_value(m)) for m in _NUMERAL.findall(x)) or None)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), r"^-|-$", "")


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for null. The characters are split once, so a long text takes linear time."""
    chars = F.split(F.coalesce(c, F.lit("")), "")
    return F.array_distinct(F.array_compact(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))))


def cited_number(c: Column) -> Column:
    """The number of a cited article (its words left out) as digits joined by underscores; what has no numeral stays, null for nothing."""
    inner = F.trim(F.replace(F.regexp_replace(F.trim(c), "^第", ""), F.lit("条"), F.lit("")))
    return F.nullif(F.coalesce(article_key(inner), inner), F.lit(""))


def joined_up(c: Column) -> Column:
    """A text without white space, as vertical print leaves it between characters."""
    return F.regexp_replace(c, r"[\s\x{3000}\x{00A0}\x{FEFF}]+", "")
