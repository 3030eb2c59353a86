"""Labels, kinds and notices by hand-made cases."""

from folio.functions import labels, segments
from pyspark.sql import functions as F


def got(spark, f, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(f.alias("x")).collect()]


def test_labels_of_every_level(spark):
    c = [F.col(x) for x in ("level", "article", "paragraph", "item", "subitem", "column", "title", "caption", "text")]
    blank = [None] * 8
    rows = [
        ["article", "五十二の二", *blank[2:], None], ["article", None, *blank[1:]], ["paragraph", None, "２", *blank[2:]], ["item", "三", None, None, *blank[3:]], ["item", None, None, "（一） ", *blank[3:]],
        ["subitem2", None, None, None, "イ（１）", None, None, None, None], ["column", *blank[:4], "2", None, None, None], ["column", *blank], ["appdx_table", "二の二", *blank[1:]], ["appdx_table", "null", *blank[1:7], "別表第一\n耐火"],
        ["appdx_table", None, *blank[1:5], "null", "cap", "none"], ["appdx_table", *blank], ["suppl_provision", *blank], ["table", *blank[:5], "T", None, None], ["other", *blank],
    ]
    own = got(spark, labels.label(*c), rows, "level string, article string, paragraph string, item string, subitem string, column string, title string, caption string, text string")
    assert own == ["第52条の2", "第条", "2", "三", "(一)", "イ(1)", "Column 2", "", "別表第2の2", "別表第1", "cap", "別表", "附則", "T", ""]


def test_titles(spark):
    assert got(spark, labels.title_numbers(F.col("t")), [["第二章の三　総則と第十二節"], ["第一条"], [None], [""]], "t string") == ["第2章の3　総則と第12節", "第一条", None, ""]
    c = [F.col(x) for x in ("level", "own", "paragraph", "title", "caption")]
    rows = [["paragraph", "", None, None, None], ["paragraph", "", "三", None, None], ["item", "", None, None, None], ["subitem1", "", None, None, None], ["chapter", "", None, None, None], ["article", "第1条", None, None, "（目的）"], ["article", "第1条", None, None, None]]
    assert got(spark, labels.display_title(*c), rows, "level string, own string, paragraph string, title string, caption string") == ["第1項", "第3項", "号", "枝番", "条文", "（目的）", "第1条"]
    chains = [[[]], [[("chapter", "A"), ("section", "B")]], [[("chapter", "A"), ("article", "C"), ("paragraph", ""), ("item", "D")]], [[("article", "")]]]
    assert got(spark, labels.context_title(F.col("c")), chains, "c array<struct<level: string, title: string>>") == ["条文", "A B", "C D", "条文"]
    assert got(spark, labels.article_label(F.col("n")), [["52_2_3"], ["1"], ["x"], [None]], "n string") == ["第五十二条の二の三", "第一条", None, None]


def test_markup_kinds_and_paths(spark):
    rows = [["<Ruby> 漢 <Rt>k</Rt></Ruby><Sub>a<Sub>b</Sub>c</Sub>"], ["<Sup>x\ny</Sup>"], ["plain"], [None]]
    assert got(spark, labels.plain_markup(F.col("x")), rows, "x string") == ["漢_a_bc", "^x\ny", "plain", None]
    assert got(spark, labels.regulation_type(F.col("t"), F.col("s")), [["刑金", False], ["懲役と許可", False], ["届出", False], ["x", False], ["罰金", True]], "t string, s boolean") == ["penalty", "penalty", "procedure", "individual", "supplementary"]
    assert got(spark, segments.leftover(F.col("p")), [["art1/para二"], ["art二/para1"], ["art1-2"], ["appdx-五"], [""]], "p string") == [True, False, False, True, False]


def test_notices(spark):
    texts = [["○ 令和8年国土交通省告示第438号"], ["平成12年 6月1日建設省告示第千四百号"], ["●告示第五号"], ["告示第五号"], [None]]
    assert got(spark, labels.notice_number(F.col("t")), texts, "t string") == ["○ 令和8年国土交通省告示第438号", "平成12年 6月1日建設省告示第千四百号", "●告示第五号", None, None]
    texts = [["建築基準法（昭和25年）別に第二条第一項の規定に基づき"], ["建築基準法の規定に基づき"], ["建築基準法。の規定に基づき"], ["建築基準法第二条"]]
    assert got(spark, labels.legal_basis(F.col("t")), texts, "t string") == ["建築基準法（昭和25年）別に第二条第一項の規定に基づき", "建築基準法の規定に基づき", None, None]
    assert got(spark, labels.promulgated(F.col("t")), [["昭和五十年一月1日 平成2年3月四日"], ["none"]], "t string") == ["平成2年3月四日", None]
