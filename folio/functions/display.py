"""How provisions are shown: numerals, parts of a whole and units in short form, with the places they come from.

tokens() cuts a text into runs, each with its place in the text and what is shown for it. The map from places to what is shown
and back are filters and running sums over these runs. The place of a run counts characters from 0; its end is behind it.
"""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from folio.functions.text import kanji_value

# Characters of numerals, and the units with their signs. RATES stand alone; the others only behind a quantity.
NUMERAL = "[零〇一二三四五六七八九十百千万億]"
RATES = {
    "一キログラムケルビンにつきキロジュール": "kJ/kgK", "マイクロシーベルト毎時": "μSv/時間", "一立方メートルにつきキログラム": "kg/m³", "メートル毎秒毎秒": "m/秒²",
    "マイクログレイ毎時": "μGy/時間", "一秒間につき立方メートル": "m³/秒", "一時間につき立方メートル": "m³/時間", "立方メートル毎時": "m³/時間", "立方メートル毎分": "m³/分",
    "一平方メートルにつきニュートン": "N/m²", "一平方メートルにつきキログラム": "kg/m²", "一立方メートルにつきニュートン": "N/m³", "一時間につきキロジュール": "kJ/時間",
    "一キログラムにつきジュール": "J/kg", "一モルにつきジュール": "J/mol", "ミリグレイ毎時": "mGy/時間", "リットル毎分": "L/分", "メートル毎秒": "m/秒",
}
UNITS = {
    "平方キロメートル": "km²", "平方メートル": "m²", "平方センチメートル": "cm²", "平方ミリメートル": "mm²", "ヘクタール": "ha", "立方メートル": "m³", "立方センチメートル": "cm³",
    "リットル": "L", "キロメートル": "km", "センチメートル": "cm", "ミリメートル": "mm", "メートル": "m", "キログラム": "kg", "ミリグラム": "mg", "グラム": "g", "ギガジュール": "GJ",
    "メガジュール": "MJ", "キロジュール": "kJ", "メガワット": "MW", "キロワット": "kW", "ジュール": "J", "ケルビン": "K", "ニュートン": "N", "パスカル": "Pa", "モル": "mol", "パーセント": "%",
}
# Words near a numeral that leave it as it is written, unless a law's number of promulgation is near; how near.
WORDED = re.compile(
    "第[一二三四五六七八九十]+種|[一二三四五六七八九十]+級|百貨店|一般|一部|一方|一時|一層|一切|一定|一体|一団|一環|一律|一例|五十音|十分(?:な|に|で)|二重|三角形"
    "|第?[一二三四五六七八九十百]+号|[一二三四五六七八九十百]の[建築物]|(?:昭和|平成|令和)[一二三四五六七八九十]+年(?!(?:法律|政令|省令|告示|内閣令)第)|第[一二三四五六七八九十]+回"
)
NEAR_BEFORE, NEAR_BEHIND = 4, 32


def _promulgated(kinds: str) -> re.Pattern:
    return re.compile(f"(?:{kinds})第[一二三四五六七八九十百千]+号")


def _longest_first(names: dict[str, str]) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


_RUN = re.compile(
    f"(?P<decimal>{NUMERAL}+・[零〇一二三四五六七八九]+)|(?P<rate>{_longest_first(RATES)})|(?<=[0-9,.．，零〇一二三四五六七八九十百千万億])(?P<unit>{_longest_first(UNITS)})"
    f"|(?P<fraction>{NUMERAL}+分の{NUMERAL}+)|(?P<number>{NUMERAL}+)"
)
_NARROW = str.maketrans({"（": "(", "）": ")"} | {chr(c + 0xFEE0): chr(c) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))})


def _digits(run: str) -> str:
    """A numeral in digits, three and three; one of no value as it is."""
    value = kanji_value(run)
    return run if value is None else f"{value:,}"


def shown_quantity(run: str) -> str:
    """A numeral in digits, three and three, that keeps the names of its myriads; one for a name without a number."""
    parts = re.findall("([^億万]*)([億万]?)", run)
    return "".join((_digits(number) if number else "1") + name for number, name in parts if number or name)


def shown_decimal(whole: str, part: str) -> str:
    """Digits before and behind the dot; those written one by one stay one by one."""
    one_by_one = {ord(x): str(i) for i, x in enumerate("〇一二三四五六七八九")} | {ord("零"): "0"}
    before = shown_quantity(whole) if re.search("[十百千万億]", whole) else whole.translate(one_by_one)
    return f"{before}.{part.translate(one_by_one)}"


def worded(before: str, run: str, behind: str, promulgated: re.Pattern) -> bool:
    """Whether a numeral between such texts stays as it is written."""
    near = before[-NEAR_BEFORE:] + run + behind[:NEAR_BEHIND]
    if promulgated.search(near):
        return False
    if before.endswith("第") and behind[:1] in tuple("号条項章節款編部"):
        return behind[0] == "号"
    return not before.endswith(("条の", "項の")) and WORDED.search(near) is not None


def runs_of(text: str | None, promulgated: re.Pattern) -> list[tuple[int, int, str, str]] | None:
    """Start, end, what is shown and kind (plain, number, fraction, unit) of each run of a text."""
    if text is None:
        return None
    found, at = [], 0

    def plain(start: int, end: int) -> None:
        if end > start:
            found.append((start, end, text[start:end].translate(_NARROW), "plain"))

    for m in _RUN.finditer(text):
        kind, run, (start, end) = m.lastgroup, m[0], m.span()
        if kind == "decimal":
            whole, _, part = run.partition("・")
            shown, kind = shown_decimal(whole, part), "number"
        elif kind in ("rate", "unit"):
            shown, kind = (RATES if kind == "rate" else UNITS)[run], "unit"
        elif kind == "fraction":
            below, _, above = run.partition("分の")
            shown = f"{_digits(above).replace(',', '')}/{_digits(below)}"
        elif (run == "零" and text[end : end + 1] == "下") or worded(text[:start], run, text[end : end + NEAR_BEHIND], promulgated):
            continue
        else:
            shown = shown_quantity(run)
        plain(at, start)
        found.append((start, end, shown, kind))
        at = end
    plain(at, len(text))
    return found


TOKENS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("shown", StringType()), StructField("kind", StringType())]))


def tokens(c: Column | str, kinds: str = "法律|政令|勅令|内閣令|省令|府令|庁令|告示|布告|規則") -> Column:
    """array<struct<start, end, shown, kind>>: the runs of a text; null for null, none for an empty text.

    Numerals that near words leave as written (kinds: those of laws whose number is shown in digits) are part of plain runs.
    """
    promulgated = _promulgated(kinds)

    @F.pandas_udf(TOKENS)
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if (r := runs_of(x, promulgated)) is None else [dict(zip(("start", "end", "shown", "kind"), t)) for t in r])

    return f(c)


def shown(found: Column, start: Column | int = 0, end: Column | int = (1 << 31) - 1) -> Column:
    """What is shown for the places from start to before end: every run that has one of them, whole."""
    return F.array_join(F.transform(F.filter(found, lambda t: (t["end"] > start) & (t["start"] < end)), lambda t: t["shown"]), "")


def source_of(found: Column, start: Column, end: Column) -> Column:
    """struct<start, end>: the places of the text behind what is shown from start to before end, whole runs; null where nothing is shown."""
    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))

    def add(a, t):
        behind = a["at"] + F.length(t["shown"])
        meets = (behind > start) & (a["at"] < end)
        return F.struct(behind.alias("at"), F.when(meets & a["start"].isNull(), t["start"]).otherwise(a["start"]).alias("start"), F.when(meets, t["end"]).otherwise(a["end"]).alias("end"))

    whole = F.aggregate(found, empty, add)
    return F.when(whole["start"].isNotNull(), F.struct(whole["start"].alias("start"), whole["end"].alias("end")))


def _unwrapped(c: Column) -> Column:
    """Without the parentheses around the whole; they stay where the first one closes before the end."""
    inner = F.regexp_extract(F.trim(c), r"^[（(](.*)[）)]$", 1)
    sign = F.transform(F.split(inner, ""), lambda x: F.when(x.isin("（", "("), 1).when(x.isin("）", ")"), -1).otherwise(0))
    lowest = F.aggregate(sign, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")), lambda a, x: F.struct((a["depth"] + x).alias("depth"), F.least(a["least"], a["depth"] + x).alias("least")))
    return F.when(F.trim(c).rlike(r"^[（(].*[）)]$") & (lowest["least"] == 0) & (lowest["depth"] == 0), F.trim(inner)).otherwise(F.trim(c))


def formula_parts(c: Column) -> Column:
    """struct<left, above, below> of a formula with one wide stroke behind its equals sign; null for another."""
    at = r"(?s)^([^=＝]*)[=＝]([^／]*)／([^／]*)$"
    left, above, below = F.trim(F.regexp_extract(c, at, 1)), _unwrapped(F.regexp_extract(c, at, 2)), _unwrapped(F.regexp_extract(c, at, 3))
    return F.when(c.rlike(at) & (above != "") & (below != ""), F.struct(left.alias("left"), above.alias("above"), below.alias("below")))


def formula_layout(c: Column) -> Column:
    """struct<introduction, formula, definitions> of a text whose formula stands on a line of its own before its signs' meanings in parentheses; null for another."""
    at = r"(?s)^((?:[^\n=＝]*\n)+)([^\n]*[=＝][^\n]*)\n[（(]([^\n]*この式において、.*)[）)]$"
    parts = [F.rtrim(F.regexp_extract(c, at, 1)), F.trim(F.regexp_extract(c, at, 2)), F.trim(F.regexp_extract(c, at, 3))]
    introduction = F.regexp_replace(parts[0], r"\s+$", "")
    return F.when(c.rlike(at) & (introduction != ""), F.struct(introduction.alias("introduction"), parts[1].alias("formula"), parts[2].alias("definitions")))


def _placed(cells: pd.DataFrame) -> pd.DataFrame:
    """The cells of one table at their columns; a cell that spans columns is repeated, below a cell that spans rows stands ''."""
    taken: dict[tuple[int, int], str] = {}
    ordered = cells.sort_values(["line", "place"])
    lines = set(ordered["line"])
    for line, own in groupby(ordered.itertuples(index=False), key=lambda x: x.line):
        column = 0
        for cell in own:
            while (line, column) in taken:
                column += 1
            for c in range(column, column + max(1, int(cell.colspan))):
                taken[line, c] = cell.text
                taken.update({(line + r, c): "" for r in range(1, max(1, int(cell.rowspan)))})
            column += max(1, int(cell.colspan))
    rows = [(line, c, text) for (line, c), text in taken.items() if line in lines]
    out = pd.DataFrame(rows, columns=["line", "column", "text"])
    out.insert(0, "table_id", cells["table_id"].iloc[0])
    return out


def table_grid(cells: DataFrame) -> DataFrame:
    """table_id, line, column and text of each place of tables, from cells (table_id, line, place in the line, text, colspan, rowspan).

    One table is one group; its size is that of a printed table. Places that no cell reaches have no row; null text is ''.
    """
    wanted = cells.select("table_id", F.col("line").cast("long"), F.col("place").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "colspan", "rowspan")
    return wanted.groupBy("table_id").applyInPandas(_placed, "table_id long, line long, column long, text string")


def column_layout(grid: DataFrame) -> DataFrame:
    """table_id, column, kind (symbol, numeric or body) and percent of the width, of each column of such a grid."""
    t = F.trim("text")
    filled = F.when(t != "", 1)
    symbol = F.when(t.rlike("^[（(][^（）()]{1,8}[）)]$"), 1)
    number = F.when(t.rlike("[0-9０-９一二三四五六七八九十百千万〇零%％㎡²]|平方メートル|立方メートル|時間"), 1)
    c = grid.groupBy("table_id", "column").agg(F.count(filled).alias("n"), F.count(symbol).alias("symbols"), F.count(number).alias("numbers"), F.max(F.length(t)).alias("longest"))
    kind = F.when(F.col("symbols") == F.col("n"), "symbol").when(F.col("numbers") >= F.ceil(F.col("n") / 2), "numeric").when(F.col("longest") <= 4, "symbol").otherwise("body")
    weight = F.when(F.col("kind") == "symbol", 1.0).when(F.col("kind") == "numeric", 2.0).otherwise(F.least(F.lit(16.0), F.greatest(F.lit(4.0), F.sqrt("longest"))))
    c = c.withColumn("kind", kind).withColumn("weight", weight)
    return c.select("table_id", "column", "kind", (F.col("weight") / F.sum("weight").over(Window.partitionBy("table_id")) * 100).alias("percent"))
