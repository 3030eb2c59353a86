"""How nodes of a law are called, what kind a provision is, and what the heading of a notice says: rules as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import numerals
from folio.functions.text import half_width, to_kanji

# Words that tell a kind of provision, in order; levels at which a context begins; ministries, eras and endings of notices.
KINDS = (("penalty", "[罰刑]金|懲役|過料|拘留"), ("procedure", "手続|申請|認定|許可|認可|届出|登録|検査済証"))
CONTEXTS = ("article", "suppl_provision", "appdx_table")
MINISTRIES = "国交省|国土交通省|建設省|厚生労働省|厚労省|環境省"
_LINE = r"[^\n]"
_COUNT = "第[0-9百千万四一二三四五六七八九十]+号"
_BY = "[0-9百千万の二三四五六七八九十]+条"


def article_label(num: Column) -> Column:
    """Article and branches in words, of digits joined by underscores."""
    words = F.transform(F.split(num, "_"), lambda n: to_kanji(n.try_cast("int")))
    branches = F.slice(words, F.lit(2), F.size(words))
    return F.concat(F.lit("第"), F.get(words, F.lit(0)), F.lit("条"), F.when(F.size(branches) > 0, F.concat(F.lit("の"), F.array_join(branches, "の"))).otherwise(""))


def paragraph_label(num: Column) -> Column:
    return F.concat(F.lit("第"), num, F.lit("項"))


def item_label(title: Column, num: Column) -> Column:
    """By the item's title, in words from its number where it has none."""
    return F.concat(F.lit("第"), F.coalesce(F.nullif(title, F.lit("")), to_kanji(num.try_cast("int"))), F.lit("号"))


def plain_markup(xml: Column) -> Column:
    """XML with readings taken out and low and high characters marked in place; marks within marks from the inside out, as deep as six."""
    xml = F.regexp_replace(xml, r"<Ruby>\s*([^<]+?)\s*(?:<Rp>[^<]*</Rp>\s*)?<Rt>[^<]*</Rt>\s*(?:<Rp>[^<]*</Rp>\s*)?</Ruby>", "$1")
    for _ in range(6):
        xml = F.regexp_replace(F.regexp_replace(xml, "<Sub>((?:(?!<Su[bp]>)[\\s\\S])*?)</Sub>", "_$1"), "<Sup>((?:(?!<Su[bp]>)[\\s\\S])*?)</Sup>", "^$1")
    return xml


def regulation_type(text: Column, supplementary: Column) -> Column:
    """supplementary, penalty, procedure or individual: the first that fits."""
    out = F.lit("individual")
    for name, form in reversed(KINDS):
        out = F.when(text.rlike(form), name).otherwise(out)
    return F.when(supplementary, "supplementary").otherwise(out)


def title_numbers(title: Column) -> Column:
    """A title with the numbers of its chapters and their branches in digits."""
    form = "第([一二三四五六七八九十百]+)(章|節|款|編|部)(の[一二三四五六七八九十百]+)?"

    def digits(m: Column) -> Column:
        branch = F.nullif(F.regexp_extract(m, form, 3), F.lit(""))
        return F.concat(F.lit("第"), numerals.reader_number(F.regexp_extract(m, form, 1)), F.regexp_extract(m, form, 2), F.coalesce(F.concat(F.lit("の"), numerals.reader_number(F.substring(branch, 2, 100))), F.lit("")))

    return numerals.woven(title, form, digits)


def label(level: Column, article: Column, paragraph: Column, item: Column, subitem: Column, column: Column, title: Column, caption: Column, text: Column) -> Column:
    """What stands before a node of each level."""
    named = numerals.article_number(article)
    first = F.regexp_extract(text, r"^別表第([^\s\n]+)", 1)
    table = F.coalesce(
        F.concat(F.lit("別表第"), F.when((article != "") & (article != "null"), named)), F.concat(F.lit("別表第"), numerals.article_number(F.nullif(first, F.lit("")))),
        F.nullif(F.nullif(title, F.lit("null")), F.lit("")), F.nullif(F.nullif(caption, F.lit("null")), F.lit("")), F.lit("別表"),
    )

    def joined(whole: Column) -> Column:
        branches = F.slice(whole, F.lit(2), F.size(whole))
        return F.concat(F.lit("第"), F.get(whole, F.lit(0)), F.lit("条"), F.when(F.size(branches) > 0, F.concat(F.lit("の"), F.array_join(branches, "の"))).otherwise(""))

    numbered = numerals.bound(F.split(F.coalesce(named, F.lit("")), "の"), joined)
    empty = F.lit("")
    return (
        F.when(level == "article", numbered).when(level == "paragraph", half_width(F.coalesce(paragraph, empty))).when(level == "item", half_width(F.trim(F.coalesce(F.nullif(item, empty), article, empty))))
        .when(level.isin("subitem1", "subitem2", "subitem3"), half_width(F.coalesce(subitem, empty))).when(level == "column", F.when(column != "", F.concat(F.lit("Column "), column)).otherwise(""))
        .when(level == "appdx_table", table).when(level == "suppl_provision", F.coalesce(title, F.lit("附則"))).when(level.isin("table_struct", "table"), F.coalesce(title, empty)).otherwise("")
    )


def display_title(level: Column, own: Column, paragraph: Column, title: Column, caption: Column) -> Column:
    """A node's heading, from its label own."""
    number = F.coalesce(numerals.article_number(F.nullif(paragraph, F.lit(""))), F.lit("1"))
    named = title_numbers(F.coalesce(title, caption, F.nullif(own, F.lit("")), F.lit("条文")))
    return (
        F.when(level == "paragraph", paragraph_label(number)).when(level == "item", F.concat(own, F.lit("号")))
        .when(level.isin("subitem1", "subitem2", "subitem3"), F.when(own != "", F.concat(F.lit("枝番 "), own)).otherwise("枝番")).otherwise(named)
    )


def context_title(chain: Column) -> Column:
    """Headings from the last article, supplement or appendix of a chain of structs (level, title) from the top; 条文 for none."""
    places = F.transform(chain, lambda c, i: F.when(c["level"].isin(*CONTEXTS), i).otherwise(0))
    begin = F.greatest(F.lit(0), F.array_max(places))
    told = F.array_join(F.filter(F.transform(F.slice(chain, begin + 1, F.size(chain)), lambda c: c["title"]), lambda t: t != ""), " ")
    return F.when(F.size(chain) == 0, "条文").otherwise(F.coalesce(F.nullif(told, F.lit("")), F.lit("条文")))


def _first(text: Column, forms: list[str]) -> Column:
    """The first pattern's first match, white space as one space; null for none."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, form, 0), F.lit("")) for form in forms])
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def notice_number(text: Column) -> Column:
    era = "(?:令和|平成|昭和)"
    tail = f"告示{_LINE}{{0,30}}?{_COUNT}"
    head = rf"[○●]\s*{era}?[0-9]*年?{_LINE}{{0,20}}?"
    return _first(text, [f"{head}(?:{MINISTRIES}){_LINE}{{0,10}}?{tail}", f"{era}[0-9]+年{_LINE}{{0,20}}?(?:{MINISTRIES}){_LINE}{{0,10}}?{tail}", f"{head}{tail}"])


def legal_basis(text: Column, act: str = "建築基準法") -> Column:
    """The article of an act by which a notice is given."""
    rest = r"[^。\n]"
    by = f"第{_BY}{rest}{{0,40}}?項?{rest}{{0,20}}?の規定に基づき"
    return _first(text, [f"{act}[（(][^)）]*[)）]{rest}{{0,60}}?{by}", f"{act}{rest}{{0,10}}?{by}", f"{act}{rest}{{0,80}}?の規定に基づき"])


def promulgated(text: Column) -> Column:
    """The day of a notice by its era, in digits or words; of several eras the newest."""
    n = "[0-9一二三四五六七八九十百千万]+"
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"{era}{n}年{n}月{n}日", 0), F.lit("")) for era in ("令和", "平成", "昭和")])
