"""Numerals as readers of a text take them, and as its segments are numbered: two rules, in Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerals of the texts.
DIGITS = "〇一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000}
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"
#: A numeral of more characters has no value that a long holds.
LONGEST = 18


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once however often f names it: a column in Python is an expression, and each mention of it a copy."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _digit(ch: Column) -> Column:
    """0 to 9 of a digit, -1 of anything else."""
    return F.position(ch, F.lit(DIGITS)).cast("long") - 1


def _unit(ch: Column) -> Column:
    """The unit's value, null of anything else."""
    out = F.lit(None).cast("long")
    for name, value in UNITS.items():
        out = F.when(ch == name, F.lit(value).cast("long")).otherwise(out)
    return out


def _state(total: Column, current: Column, fine: Column) -> Column:
    return F.struct(total.cast("long").alias("total"), current.cast("long").alias("current"), fine.alias("fine"))


def _some(n: Column) -> Column:
    """A unit without a number before it counts once."""
    return F.when(n == 0, 1).otherwise(n)


def segment_number(c: Column) -> Column:
    """Value of one part of a segment's number: digits run on (two five before ten is 250), units to a thousand; null with any other character."""

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = _digit(ch), _unit(ch)
        on = _state(acc["total"], acc["current"] * 10 + digit, acc["fine"])
        unit_of = _state(acc["total"] + _some(acc["current"]) * unit, F.lit(0), acc["fine"])
        return F.when(~acc["fine"], acc).when(digit >= 0, on).when(unit.isNotNull(), unit_of).otherwise(_state(F.lit(0), F.lit(0), F.lit(False)))

    start = _state(F.lit(0), F.lit(0), F.char_length(c).between(1, LONGEST))
    return F.when(c != "", F.aggregate(F.split(c, ""), start, step, lambda acc: F.when(acc["fine"], acc["total"] + acc["current"])))


def segment_key(c: Column) -> Column:
    """Numbers of a segment with branches, joined by hyphens; null where a part is no number."""
    parts = F.transform(F.split(c, "の"), segment_number)
    return F.when(F.forall(parts, lambda n: n.isNotNull()), F.array_join(F.transform(parts, lambda n: n.cast("string")), "-"))


def _value(c: Column) -> Column:
    """A numeral below ten thousand as a reader takes it: digits alone run on, of digits before a unit the last counts, other characters say nothing."""

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = _digit(ch), _unit(ch)
        plain = F.position(ch, F.lit(_PLAIN)).cast("long") - 1
        unit_of = _state(acc["total"] + _some(acc["current"]) * unit, F.lit(0), acc["fine"])
        digit_of = _state(acc["total"], F.when(digit > 0, digit).otherwise(plain), acc["fine"])
        return F.when(unit.isNotNull(), unit_of).when((digit > 0) | (plain >= 0), digit_of).otherwise(acc)

    def told(c: Column) -> Column:
        digits = F.translate(c, f"零{DIGITS}", f"0{_PLAIN}").try_cast("decimal(38,0)")
        leading = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("decimal(38,0)")
        units = F.aggregate(F.split(c, ""), _state(F.lit(0), F.lit(0), F.lit(True)), step, lambda acc: (acc["total"] + acc["current"]).cast("decimal(38,0)"))
        value = F.when(~c.rlike("[一二三四五六七八九十百千]"), leading).when(c.rlike("^[0-9零〇一二三四五六七八九]+$"), digits).otherwise(units)
        return F.coalesce(value, F.lit(0).cast("decimal(38,0)"))

    return bound(c, told)


def woven(c: Column, form: str, put: Callable[[Column], Column]) -> Column:
    """c with each match of a pattern (never empty) replaced by what put makes of it."""

    def told(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(form), F.lit(0))
        whole = bound(found, lambda found: F.array_join(F.transform(F.split(c, form, -1), lambda x, i: F.concat(x, F.coalesce(put(F.get(found, i)), F.lit("")))), ""))
        return F.when(c.rlike(form), whole).otherwise(c)

    return bound(c, told)


def _where_numeral(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a text with a numeral that readers write otherwise; any other text stays, at the cost of one look."""
    return bound(c, lambda c: F.when(c.rlike(f"[{_WIDE}零{DIGITS}十百千万]"), f(c)).otherwise(c))


def reader_number(c: Column) -> Column:
    """A numeral in digits, as readers write it: full width, digit by digit, with units, ten thousands (one where nothing stands before) and fractions; a text without a numeral stays."""
    form = r"([〇零一二三四五六七八九]*)[・.]([〇零一二三四五六七八九]+)"
    digits = (f"零{DIGITS}", f"0{_PLAIN}")

    def fraction(m: Column) -> Column:
        whole = F.regexp_extract(m, form, 1)
        return F.concat(F.when(F.char_length(whole) == 1, F.translate(whole, *digits)).otherwise("0"), F.lit("."), F.translate(F.regexp_extract(m, form, 2), *digits))

    def told(c: Column) -> Column:
        def myriads(parts: Column) -> Column:
            upper, lower = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            both = F.try_add(F.try_multiply(_value(F.when(upper == "", "一").otherwise(upper)), F.lit(10_000)), _value(lower))
            return F.when(F.size(parts) == 2, both.cast("decimal(38,0)")).otherwise(_value(c))

        return F.when(c.rlike("[一二三四五六七八九十百千万]"), bound(F.split(c, "万", -1), myriads).cast("string")).otherwise(c)

    return _where_numeral(c, lambda c: bound(woven(F.translate(c, _WIDE, _PLAIN), form, fraction), told))


def article_number(c: Column) -> Column:
    """The number of a cited article, each of its branches in digits."""
    return _where_numeral(c, lambda c: F.array_join(F.transform(F.split(c, "の", -1), reader_number), "の"))


def citation_number(c: Column) -> Column:
    """Value of a number in a citation: of digits in a row the last counts, unless all are of the Latin kind."""

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = _digit(ch), _unit(ch)
        unit_of = _state(acc["total"] + _some(acc["current"]) * unit, F.lit(0), acc["fine"])
        return F.when(unit.isNotNull(), unit_of).when(digit >= 0, _state(acc["total"], digit, acc["fine"])).otherwise(acc)

    units = F.aggregate(F.split(c, ""), _state(F.lit(0), F.lit(0), F.lit(True)), step, lambda acc: acc["total"] + acc["current"])
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long")).otherwise(units)
