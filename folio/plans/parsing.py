"""Numerals, titles, segments, references and spans: texts made from the driver's tables, so that SQL knows what is in them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import citations, labels, nodes, numerals, references, segments, text
from folio.plans.registering import Register
from folio.tables import spread, table

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

_DIGITS = "〇一二三四五六七八九"


def _kanji(n: str) -> str:
    """SQL for 1 to 9999 with units."""
    out = []
    for unit, name in ((1000, "千"), (100, "百"), (10, "十")):
        d = f"(({n}) // {unit} % 10)"
        out.append(f"CASE {d} WHEN 0 THEN '' WHEN 1 THEN '{name}' ELSE substr('{_DIGITS}', ({d} + 1)::BIGINT, 1) || '{name}' END")
    return "(" + " || ".join([*out, f"CASE ({n}) % 10 WHEN 0 THEN '' ELSE substr('{_DIGITS}', (({n}) % 10 + 1)::BIGINT, 1) END"]) + ")"


def _numbers(spark, sf_dir):
    """p_partkey and two numbers from 1 to 9999 that follow from it."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return p.withColumn("n", F.col("p_partkey") % 9999 + 1).withColumn("m", (F.col("p_partkey") * 7) % 97 + 1)


_N = "SELECT p_partkey, p_partkey % 9999 + 1 AS n, (p_partkey * 7) % 97 + 1 AS m FROM part"


def _in_digits(c, digits=_DIGITS):
    return F.translate(c.cast("string"), "0123456789", digits)


@query(f"""WITH n AS ({_N}) SELECT p_partkey, 'units' AS form, n::VARCHAR AS value FROM n UNION ALL SELECT p_partkey, 'digits', n::VARCHAR FROM n UNION ALL SELECT p_partkey, 'wide', n::VARCHAR FROM n
UNION ALL SELECT p_partkey, 'myriads', (n * 10000 + m)::VARCHAR FROM n UNION ALL SELECT p_partkey, 'decimal', (n % 10) || '.' || lpad((m % 100)::VARCHAR, 2, '0') FROM n UNION ALL SELECT p_partkey, 'other', 'x' || n FROM n
UNION ALL SELECT p_partkey, 'lone', (10000 + m)::VARCHAR FROM n UNION ALL SELECT p_partkey, 'within', n::VARCHAR FROM n UNION ALL SELECT p_partkey, 'last digit', ((m % 9 + 1) * 10)::VARCHAR FROM n""")
def n5_reader_numbers(spark, sf_dir):
    """Numerals of all forms in digits: with units, digit by digit, full width, with myriads, with a fraction, within words; other text stays."""
    n, m = F.col("n"), F.col("m")
    forms = {"units": text.to_kanji(n), "digits": _in_digits(n), "wide": _in_digits(n, "０１２３４５６７８９"), "myriads": F.concat(text.to_kanji(n), F.lit("万"), text.to_kanji(m)),
             "decimal": F.concat(_in_digits(n % 10), F.lit("・"), _in_digits(F.lpad((m % 100).cast("string"), 2, "0"))), "other": F.concat(F.lit("x"), n.cast("string")),
             "lone": F.concat(F.lit("万"), text.to_kanji(m)), "within": F.concat(F.lit("第"), text.to_kanji(n), F.lit("条")), "last digit": F.concat(F.lit("二"), _in_digits(m % 9 + 1), F.lit("十"))}
    rows = _numbers(spark, sf_dir).select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), c.alias("text")) for k, c in forms.items()])).alias("x"))
    return rows.select("p_partkey", "x.form", numerals.reader_number(F.col("x.text")).alias("value"))


@query(f"""WITH n AS ({_N}) SELECT p_partkey, n AS value, NULL::BIGINT AS broken, NULL::BIGINT AS myriads, (20 + m % 10) * 10 AS run, n || '-' || m AS branch FROM n""")
def n6_segmenter_numbers(spark, sf_dir):
    """Values of segments' numbers: runs of digits before a unit, branches; none for one with a strange character or ten thousands."""
    k, m = F.col("k"), F.col("m")
    rows = _numbers(spark, sf_dir).select("p_partkey", text.to_kanji(F.col("n")).alias("k"), text.to_kanji(F.col("m")).alias("j"), "m")
    own = numerals.segment_number
    return rows.select(
        "p_partkey", own(k).alias("value"), own(F.concat(k, F.lit("x"))).alias("broken"), own(F.concat(k, F.lit("万"))).alias("myriads"),
        own(F.concat(F.lit("二"), _in_digits(m % 10), F.lit("十"))).alias("run"), numerals.segment_key(F.concat(k, F.lit("の"), F.col("j"))).alias("branch"),
    )


@query(f"WITH n AS ({_N}) SELECT p_partkey, {_kanji('n')} AS kanji FROM n")
def n7_kanji(spark, sf_dir):
    """Numbers with units."""
    return _numbers(spark, sf_dir).select("p_partkey", text.to_kanji(F.col("n")).alias("kanji"))


def _title(n="n", m="m"):
    return F.concat(F.lit("第"), text.to_kanji(F.col(n)), F.lit("条の"), text.to_kanji(F.col(m)))


@query(f"WITH n AS ({_N}) SELECT p_partkey, n || '_' || m AS number, n::VARCHAR AS plain FROM n")
def n8_article_numbers(spark, sf_dir):
    """Numbers of articles with branches, in digits joined by underscores."""
    plain = F.concat(F.lit("第"), text.to_kanji(F.col("n")), F.lit("条"))
    return _numbers(spark, sf_dir).select("p_partkey", text.article_key(_title()).alias("number"), text.article_key(plain).alias("plain"))


@query(f"""WITH n AS ({_N}) SELECT p_partkey, '第' || {_kanji('n')} || '条' || CASE WHEN p_partkey % 3 > 0 THEN 'の' || {_kanji('m')} ELSE '' END || CASE WHEN p_partkey % 3 > 1 THEN 'の二' ELSE '' END AS article, '第' || m || '項' AS paragraph,
 CASE WHEN p_partkey % 2 = 0 THEN '第イ号' ELSE '第' || {_kanji('m')} || '号' END AS item FROM n""")
def n10_labels(spark, sf_dir):
    """Labels of an article with any number of branches, of a paragraph, and of an item by its title or, without one, its number."""
    n, m, kind = F.col("n").cast("string"), F.col("m").cast("string"), F.col("p_partkey") % 3
    num = F.concat_ws("_", n, F.when(kind > 0, m), F.when(kind > 1, "2"))
    title = F.when(F.col("p_partkey") % 2 == 0, "イ").otherwise("")
    return _numbers(spark, sf_dir).select("p_partkey", labels.article_label(num).alias("article"), labels.paragraph_label(m).alias("paragraph"), labels.item_label(title, m).alias("item"))


@query(f"WITH n AS ({_N}) SELECT p_partkey, '第' || n || '条の' || m AS title FROM n")
def n27_titles(spark, sf_dir):
    """Titles with their numerals in digits."""
    return _numbers(spark, sf_dir).select("p_partkey", text.digits_in_title(_title()).alias("title"))


@query("""WITH q AS (SELECT o_orderkey, o_orderkey * 1234567 AS q FROM orders)
SELECT o_orderkey, CASE WHEN q = 0 THEN '0' ELSE CASE WHEN q // 100000000 > 0 THEN format('{:,}', q // 100000000) || '億' ELSE '' END || CASE WHEN q // 10000 % 10000 > 0 THEN format('{:,}', q // 10000 % 10000) || '万' ELSE '' END || CASE WHEN q % 10000 > 0 THEN format('{:,}', q % 10000) ELSE '' END END AS quantity FROM q""")
def n28_quantities(spark, sf_dir):
    """Large numbers with the names of their myriads."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.quantity(F.col("o_orderkey") * 1234567).alias("quantity"))


@query(f"WITH n AS ({_N}) SELECT p_partkey, m || '/' || format('{{:,}}', n) AS fraction, '{_DIGITS[1]}x' AS other FROM n")
def n29_fractions(spark, sf_dir):
    """Parts of a whole with a stroke."""
    parts = F.concat(text.to_kanji(F.col("n")), F.lit("分の"), text.to_kanji(F.col("m")))
    return _numbers(spark, sf_dir).select("p_partkey", text.fraction(parts).alias("fraction"), text.fraction(F.lit(f"{_DIGITS[1]}x")).alias("other"))


@query(f"""WITH n AS ({_N}) SELECT p_partkey, ['table', 'style', 'note', 'appdx'][p_partkey % 4 + 1] || '-' || n || '-' || m AS slug, NULL::VARCHAR AS none FROM n""")
def n4_appendix_slugs(spark, sf_dir):
    """Kind and number of appendices by their element and title."""
    tags = F.array(*[F.lit(t) for t in ("AppdxTable", "AppdxStyle", "AppdxNote", "AppdxFig")])
    title = F.concat(F.lit("別表第"), text.to_kanji(F.col("n")), F.lit("の"), text.to_kanji(F.col("m")))
    return _numbers(spark, sf_dir).select("p_partkey", text.appendix_slugs(F.get(tags, F.col("p_partkey") % 4), title).alias("slug"), text.appendix_slugs(F.lit("Article"), title).alias("none"))


@query("SELECT p_partkey, '漢' || p_name || '_' || p_size || '^2_a^b_c' AS plain FROM part")
def n16_plain_text(spark, sf_dir):
    """Readings taken out, low and high characters marked, within each other too."""
    xml = F.concat(F.lit("<Ruby>漢<Rp>(</Rp><Rt>かん</Rt><Rp>)</Rp></Ruby>"), "p_name", F.lit("<Sub>"), F.col("p_size").cast("string"), F.lit("</Sub><Sup>2</Sup><Sub>a<Sup>b<Sub>c</Sub></Sup></Sub>"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.plain_markup(xml).alias("plain"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'supplementary' WHEN p_partkey % 5 = 0 THEN 'penalty' WHEN p_partkey % 5 < 3 THEN 'procedure' ELSE 'individual' END AS kind FROM part""")
def n21_classified(spark, sf_dir):
    """What kind of provision a text is, by the first rule that fits."""
    says = F.element_at(F.array(*map(F.lit, ("罰金に処する許可", "の届出", "検査済証", "の基準", "罰則"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.regulation_type(F.concat("p_name", says), F.col("p_size") % 7 == 0).alias("kind"))


@query("SELECT p_partkey, p_name AS caption FROM part")
def n22_captions(spark, sf_dir):
    """Captions without the brackets around them."""
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.concat(F.lit("（"), "p_name", F.lit("）")), "^[（(]|[）)]$", "").alias("caption"))


@query("SELECT p_partkey, translate(p_partkey::VARCHAR, '0123456789', '０１２３４５６７８９') AS wide, p_partkey || 'aZ' AS half FROM part")
def n25_widths(spark, sf_dir):
    """Digits in full width, and back."""
    wide = _in_digits(F.col("p_partkey"), "０１２３４５６７８９")
    return table(spark, sf_dir, "part").select("p_partkey", wide.alias("wide"), text.half_width(F.concat(wide, F.lit("ａＺ"))).alias("half"))


@query(f"""WITH n AS ({_N}), k AS (SELECT *, {_kanji('n')} AS kn, {_kanji('m % 90 + 1')} AS km FROM n)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '第' || (m % 90 + 1) || '章の2 総則' ELSE '第' || n || '条の' || m END || CASE p_partkey % 4 WHEN 2 THEN ' 第' || m || '項' WHEN 3 THEN ' 第1項 ' || kn || '号 枝番 (A)' ELSE '' END AS title FROM k""")
def n26_context_labels(spark, sf_dir):
    """How a node is called with what it stands in: chapters by their titles, articles, paragraphs, items and their branches."""
    kn, case, fields = text.to_kanji(F.col("n")), F.col("p_partkey") % 4, ("article", "paragraph", "item", "subitem", "title")

    def node(level, **given):
        return F.struct(F.lit(level).alias("level"), *[given.get(c, F.lit(None)).cast("string").alias(c) for c in fields])

    chapter = node("chapter", title=F.concat(F.lit("第"), text.to_kanji(F.col("m") % 90 + 1), F.lit("章の二 総則")))
    article = node("article", article=F.concat(kn, F.lit("の"), text.to_kanji(F.col("m"))))
    chain = (
        F.when(case == 0, F.array(chapter)).when(case == 1, F.array(chapter, article)).when(case == 2, F.array(chapter, article, node("paragraph", paragraph=F.col("m"))))
        .otherwise(F.array(chapter, article, node("paragraph"), node("item", item=kn), node("subitem1", subitem=F.lit("（Ａ）"))))
    )
    rows = _numbers(spark, sf_dir).select("p_partkey", F.posexplode(chain).alias("step", "c")).select("p_partkey", "step", "c.*")
    none = F.lit(None).cast("string")
    own = labels.label(F.col("level"), F.col("article"), F.col("paragraph"), F.col("item"), F.col("subitem"), none, F.col("title"), none, none)
    rows = rows.withColumn("own", own).withColumn("shown", labels.display_title(F.col("level"), F.col("own"), F.col("paragraph"), F.col("title"), none))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("step", "level", "shown"))), lambda x: F.struct(x["level"].alias("level"), x["shown"].alias("title")))
    return rows.groupBy("p_partkey").agg(steps.alias("chain")).select("p_partkey", labels.context_title(F.col("chain")).alias("title"))


@query(f"""WITH n AS ({_N}), k AS (SELECT *, {_kanji('n')} AS kn, {_kanji('m')} AS km FROM n)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '○国土交通省告示第' || kn || '号' WHEN 1 THEN '令和8年 建設省告示第' || n || '号' ELSE '●告示第' || n || '号' END AS number,
 '建築基準法' || CASE p_partkey % 2 WHEN 0 THEN '（昭和二十五年法律第二百一号）第' ELSE '第' END || kn || '条第二項の規定に基づき' AS basis,
 CASE p_partkey % 3 WHEN 0 THEN '平成' || km || '年一月二日' WHEN 1 THEN '令和8年' || (m % 12 + 1) || '月3日' END AS day FROM k""")
def n35_notices(spark, sf_dir):
    """Number, legal basis and day out of a notice's text, in all the forms that these have."""
    kn, km, n, case = text.to_kanji(F.col("n")), text.to_kanji(F.col("m")), F.col("n").cast("string"), F.col("p_partkey") % 3
    number = F.when(case == 0, F.concat(F.lit("○国土交通省告示第"), kn, F.lit("号"))).when(case == 1, F.concat(F.lit("令和8年  建設省告示第"), n, F.lit("号"))).otherwise(F.concat(F.lit("●告示第"), n, F.lit("号")))
    basis = F.concat(F.lit("建築基準法"), F.when(F.col("p_partkey") % 2 == 0, "（昭和二十五年法律第二百一号）第").otherwise("第"), kn, F.lit("条第二項の規定に基づき"))
    day = F.when(case == 0, F.concat(F.lit("平成"), km, F.lit("年一月二日"))).when(case == 1, F.concat(F.lit("平成3年4月5日、令和8年"), (F.col("m") % 12 + 1).cast("string"), F.lit("月3日"))).otherwise("日付なし")
    says = F.concat(number, F.lit("\n"), basis, F.lit("、次のように定める。\n"), day).alias("t")
    t = _numbers(spark, sf_dir).select("p_partkey", says)
    return t.select("p_partkey", labels.notice_number(F.col("t")).alias("number"), labels.legal_basis(F.col("t")).alias("basis"), labels.promulgated(F.col("t")).alias("day"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE round(len(regexp_extract_all(text, '[A-Za-z]')) / length(text), 4) END AS latin FROM documents")
def n36_script_share(spark, sf_dir):
    """Share of plain Latin letters."""
    return table(spark, sf_dir, "documents").select("doc_id", text.share_of(F.col("text"), "[A-Za-z]").alias("latin"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[ \t\n\r]', '', 'g')) AS n, split_part(text, chr(10), 1) AS first_line FROM documents")
def n38_lines(spark, sf_dir):
    """A text's first line, and how long it is without white space."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[ \t\n\r]", "")).cast("long").alias("n"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("first_line"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS anchor FROM pages")
def n40_anchors(spark, sf_dir):
    """Addresses as anchors."""
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("anchor"))


@query("SELECT c_custkey, c_name || CASE WHEN c_acctbal < 0 THEN ' (closed)' ELSE '' END AS label FROM customer")
def n41_list_labels(spark, sf_dir):
    """Names in a list, those that are closed marked."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_acctbal") < 0, " (closed)").otherwise("")).alias("label"))


@query("""SELECT p_partkey, sha256('{"body":"' || p_name || '","children":[{"key":"a","size":' || p_size || '}],"title":null}') AS checksum FROM part""")
def n19_canonical(spark, sf_dir):
    """Checksum of nested content as JSON with sorted keys, nulls kept."""
    body = F.struct(F.col("p_name").alias("body"), F.array(F.struct(F.lit("a").alias("key"), F.col("p_size").alias("size"))).alias("children"), F.lit(None).cast("string").alias("title"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.to_json(body, {"ignoreNullFields": "false"}).cast("binary"), 256).alias("checksum"))


# Segments of XML


def _laws(spark, sf_dir):
    """A law for each customer, in XML: an article for each order, a paragraph for each line, a closing chapter and an appendix."""
    by_line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(by_line).alias("i"), "l_partkey")
    paragraph = F.concat(F.lit('<Paragraph Num="'), F.col("i").cast("string"), F.lit('"><ParagraphNum>'), F.col("i").cast("string"), F.lit("</ParagraphNum><ParagraphSentence><Sentence>part "), F.col("l_partkey").cast("string"), F.lit("</Sentence></ParagraphSentence></Paragraph>"))
    inside = li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", paragraph.alias("x"))))["x"], "").alias("paragraphs"))
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("a"))
    o = o.join(inside, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    article = F.concat(F.lit('<Article Num="'), F.col("a").cast("string"), F.lit('"><ArticleCaption>（order '), F.col("o_orderkey").cast("string"), F.lit("）</ArticleCaption>"), F.coalesce("paragraphs", F.lit("")), F.lit("</Article>"))
    laws = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("a", article.alias("x"))))["x"], "").alias("articles"))
    end = "<AppdxTable><AppdxTableTitle>別表第二</AppdxTableTitle>rest</AppdxTable>"
    return laws.select("doc_id", F.concat(F.lit("<Law><MainProvision><Chapter><ChapterTitle>one</ChapterTitle>"), "articles", F.lit(f"</Chapter></MainProvision>{end}</Law>")).alias("xml"))


_SEGMENTS = """WITH a AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders),
l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
s AS (SELECT DISTINCT doc_id, 0 AS a, 0 AS i, '' AS path, 'Chapter' AS level, '' AS body FROM a UNION ALL SELECT doc_id, a, 0, 'art' || a, 'Article', '' FROM a
 UNION ALL SELECT doc_id, a, i, 'art' || a || '/para' || i, 'Paragraph', 'part ' || l_partkey FROM a JOIN l ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT doc_id, 1000000000, 0, 'appdx-table-2', 'AppdxTable', 'rest' FROM a)"""


@query(_SEGMENTS + "SELECT doc_id, path, level, body, row_number() OVER (PARTITION BY doc_id ORDER BY a, i)::INT AS sequence FROM s")
def n2_segments(spark, sf_dir):
    """Segments of laws with their addresses, in document order."""
    return segments.segmented(_laws(spark, sf_dir)).select("doc_id", "path", "level", "body", "sequence")


@query(_SEGMENTS + """, k AS (SELECT doc_id, count(*) AS segments, sum(length(replace(body, ' ', ''))) AS captured FROM s GROUP BY 1) SELECT doc_id, segments, count(*) FILTER (level = 'Paragraph') AS paragraphs FROM s JOIN k USING (doc_id) GROUP BY ALL""".replace(", sum(length(replace(body, ' ', ''))) AS captured", ""))
def n1_parse_statistics(spark, sf_dir):
    """How many segments, and of these paragraphs, each law has; no errors."""
    s = segments.segmented(_laws(spark, sf_dir)).filter("error is null")
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("level") == "Paragraph").alias("paragraphs"))


@query(_SEGMENTS + """SELECT doc_id, path, CASE level WHEN 'Paragraph' THEN regexp_replace(path, '/[^/]*$', '') END AS parent, left(sha256(body), 16) AS fingerprint, coalesce(nullif(path, ''), left(sha256(body), 16)) AS durable FROM s""")
def n18_durable_keys(spark, sf_dir):
    """Addresses of segments, their parents' and fingerprints; a segment without an address goes by its fingerprint."""
    s = segments.segmented(_laws(spark, sf_dir))
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", ""))
    return s.select("doc_id", "path", parent.alias("parent"), "fingerprint", F.coalesce(F.when(F.col("path") != "", F.col("path")), F.col("fingerprint")).alias("durable"))


@query(_SEGMENTS + """, r AS (SELECT doc_id, path, level, body, row_number() OVER (PARTITION BY doc_id ORDER BY a, i) AS n FROM s) SELECT doc_id || '-' || lpad(n::VARCHAR, 6, '0') AS id, CASE WHEN level = 'Paragraph' THEN doc_id || '-' || lpad(p::VARCHAR, 6, '0') END AS parent_id, body
FROM (SELECT *, max(CASE WHEN level = 'Article' THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM r)""")
def n20_article_rows(spark, sf_dir):
    """Rows with ids from their place in the source, and their parents' ids."""
    s = segments.segmented(_laws(spark, sf_dir)).select("doc_id", "above", "body", "sequence")

    def id_of(c):
        return F.concat_ws("-", F.col("doc_id").cast("string"), F.lpad(F.col(c).cast("string"), 6, "0"))

    return s.select(id_of("sequence").alias("id"), F.when(F.col("above").isNotNull(), id_of("above")).alias("parent_id"), "body")


# References and spans


def _texts(spark, sf_dir):
    """A text with four references of known place, for each part."""
    n, m = F.col("n"), F.col("m")
    parts = [F.lit("法第"), text.to_kanji(n), F.lit("条の"), text.to_kanji(m), F.lit("の二及び令第"), text.to_kanji(m), F.lit("条第二項、第"), text.to_kanji(n), F.lit("条並びに別表第"), text.to_kanji(m)]
    return _numbers(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat(*parts).alias("text"))


_REFERENCES = f"""WITH n AS ({_N}), k AS (SELECT p_partkey AS id, n, m, {_kanji('n')} AS kn, {_kanji('m')} AS km FROM n),
p AS (SELECT *, '法第' || kn || '条の' || km || 'の二' AS r1, '令第' || km || '条' AS r2, '第' || kn || '条' AS r3, '別表第' || km AS r4 FROM k),
r AS (SELECT id, 0 AS start, r1 AS reference, n || 'の' || m || 'の2' AS number, 'act' AS law, 'article' AS level FROM p UNION ALL SELECT id, length(r1) + 2, r2, m::VARCHAR, 'order', 'article' FROM p
 UNION ALL SELECT id, length(r1) + 6 + length(r2), r3, n::VARCHAR, 'same', 'article' FROM p UNION ALL SELECT id, length(r1) + 9 + length(r2) + length(r3), r4, m::VARCHAR, 'same', 'appendix' FROM p)"""


@query(_REFERENCES + 'SELECT id, start::INT AS start, (start + length(reference))::INT AS "end", reference, number, law, level FROM r')
def l1_references(spark, sf_dir):
    """References in texts, by place; kinds in order of priority claim their characters."""
    return references.detected(_texts(spark, sf_dir))


@query(_REFERENCES + "SELECT id, string_agg(law || ':' || number, ',' ORDER BY start) AS links FROM r WHERE level = 'article' AND split_part(number, 'の', 1)::BIGINT % 2 = 0 GROUP BY 1")
def l3_runtime_links(spark, sf_dir):
    """References that resolve, each distinct one looked up once, grouped by text; articles with an even number exist."""
    found = references.detected(_texts(spark, sf_dir)).filter("level = 'article'")
    known = found.select("law", "number").distinct().filter("cast(split_part(number, 'の', 1) as long) % 2 = 0").withColumn("target", F.concat_ws(":", "law", "number"))
    links = F.array_sort(F.collect_list(F.struct("start", "target")))
    return references.resolved(found, known, ["law", "number"]).filter("target is not null").groupBy("id").agg(F.array_join(F.transform(links, lambda x: x.target), ",").alias("links"))


_NAMED = f"""WITH n AS ({_N}), k AS (SELECT n.*, {_kanji('n')} AS kn, {_kanji('m')} AS km, r_name AS r, r_regionkey AS rk FROM n JOIN region ON r_regionkey = p_partkey % 5)"""


def _named(spark, sf_dir):
    """Parts with their numbers in words and one of the regions, whose name a law bears."""
    r = table(spark, sf_dir, "region").select("r_name", "r_regionkey")
    k = _numbers(spark, sf_dir).withColumn("kn", text.to_kanji(F.col("n"))).withColumn("km", text.to_kanji(F.col("m")))
    return k.join(r, F.col("r_regionkey") == F.col("p_partkey") % 5)


def _catalogue(spark, sf_dir):
    """Names of laws: of each region an act and an order, whose name has the act's within."""
    r = table(spark, sf_dir, "region")
    act = r.select(F.concat("r_name", F.lit("法")).alias("name"), F.concat(F.lit("a"), "r_regionkey").alias("id"))
    return act.unionByName(r.select(F.concat("r_name", F.lit("法施行令")).alias("name"), F.concat(F.lit("o"), "r_regionkey").alias("id")))


@query(_NAMED + """, t AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'a' || rk ELSE 'o' || rk END AS cited, r || CASE WHEN p_partkey % 2 = 0 THEN '法第' ELSE '法施行令第' END || kn || '条' AS s FROM k),
h AS (SELECT 'a' || rk AS law, n, max(p_partkey::VARCHAR) AS id FROM k GROUP BY 1, 2), b AS (SELECT p_partkey, lag(p_partkey::VARCHAR) OVER (PARTITION BY rk ORDER BY p_partkey) AS before FROM k)
SELECT p_partkey::VARCHAR AS id, 0 AS start, s AS text, 'law' AS kind, cited AS target_law, t.n::VARCHAR AS number, h.id AS target FROM t LEFT JOIN h ON h.law = cited AND h.n = t.n
UNION ALL SELECT p_partkey::VARCHAR, length(s) + 1, '前条', 'previous', NULL, '前条', before FROM t JOIN b USING (p_partkey)
UNION ALL SELECT p_partkey::VARCHAR, length(s) + 5, '第' || km || '項', 'paragraph', NULL, m::VARCHAR, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || '/p' END FROM t
UNION ALL SELECT p_partkey::VARCHAR, length(s) + 8 + length(km), '別表第' || km, 'appendix', NULL, m::VARCHAR, NULL FROM t
UNION ALL SELECT p_partkey::VARCHAR, length(s) + 13 + 2 * length(km), '同条', 'same', NULL, '同条', NULL FROM t""".replace("id, 0 AS start", "id, 0::BIGINT AS start").replace("length(s) +", "length(s)::BIGINT +"))
def l5_relative_links(spark, sf_dir):
    """Links in the texts of parts as articles: by the name of a law, to the article before, a paragraph, an appendix and the text's parent, with what they lead to."""
    k = _named(spark, sf_dir)
    s = F.concat("r_name", F.when(F.col("p_partkey") % 2 == 0, "法第").otherwise("法施行令第"), "kn", F.lit("条"))
    says = F.concat(s, F.lit("、前条、 第"), "km", F.lit("項、別表第"), "km", F.lit("及び同条")).alias("text")
    key = F.col("p_partkey").cast("string")
    none = F.lit(None).cast("string")
    heads = k.select(key.alias("id"), F.concat(F.lit("a"), "r_regionkey").alias("law"), none.alias("parent"), F.lit("article").alias("level"), F.col("n").cast("string").alias("number"), F.col("p_partkey").alias("place"), says)
    below = k.filter("p_partkey % 3 = 0").select(F.concat(key, F.lit("/p")).alias("id"), F.concat(F.lit("a"), "r_regionkey").alias("law"), key.alias("parent"), F.lit("paragraph").alias("level"), F.col("m").cast("string").alias("number"), F.lit(1).cast("long").alias("place"), none.alias("text"))
    return citations.linked(heads.unionByName(below), _catalogue(spark, sf_dir)).drop("end")


@query(_NAMED + """, c AS (SELECT p_partkey AS id, length(r) + 4 AS start, '第' || kn || '条の' || km AS raw, 'o' || rk AS law, 'art' || n || '-' || m AS path, 'art' || n || '-' || m || '/para1' AS alternates, 'EXPLICIT' AS method, 0.95 AS confidence FROM k WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 1, '第' || kn || '条第' || km || '項', '@法', 'art' || n || '/para' || m, '', 'ABBREVIATED', 0.8 FROM k WHERE p_partkey % 4 = 1
UNION ALL SELECT p_partkey, 0, '前項', 'own', 'art7/para' || (p_partkey % 5 + 1), '', 'RELATIVE', 0.75 FROM k WHERE p_partkey % 4 = 2 UNION ALL SELECT p_partkey, 4, '次条', 'own', 'art8', '', 'RELATIVE', 0.75 FROM k WHERE p_partkey % 4 = 2
UNION ALL SELECT p_partkey, 0, '平成' || km || '年建設省告示第' || kn || '号', '平成' || m || '年建設省告示第' || n || '号', NULL, '', 'EXPLICIT', 0.9 FROM k WHERE p_partkey % 4 = 3
UNION ALL SELECT p_partkey, length(kn) + length(km) + 11, '第' || kn || '条第' || km || '号', 'own', 'art' || n || '/para1/item' || m, 'art' || n || '/item' || m, 'EXPLICIT', 0.7 FROM k WHERE p_partkey % 4 = 3)
SELECT id, start::INT AS start, raw, law, path, alternates, method, confidence::DOUBLE AS confidence FROM c""")
def l7_citations(spark, sf_dir):
    """Citations in texts by the name of a law (with another within), by an abbreviation, by relative words, of a notice and without a name, with the paths that they lead to."""
    case = F.col("p_partkey") % 4
    says = (
        F.when(case == 0, F.concat("r_name", F.lit("法施行令第"), "kn", F.lit("条の"), "km")).when(case == 1, F.concat(F.lit("法第"), "kn", F.lit("条第"), "km", F.lit("項")))
        .when(case == 2, "前項及び次条").otherwise(F.concat(F.lit("平成"), "km", F.lit("年建設省告示第"), "kn", F.lit("号、第"), "kn", F.lit("条第"), "km", F.lit("号")))
    )
    here = F.concat(F.lit("art7/para"), (F.col("p_partkey") % 5 + 2).cast("string"))
    texts = _named(spark, sf_dir).select(F.col("p_partkey").alias("id"), says.alias("text"), F.lit("own").alias("law"), here.alias("here"))
    return citations.resolved(texts, _catalogue(spark, sf_dir)).drop("end").withColumn("alternates", F.array_join("alternates", ","))


@query("""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), t AS (SELECT href, count(*) AS n FROM l GROUP BY 1)
SELECT page_id, count(*) AS outgoing, sum(n)::BIGINT AS shared, count(*) FILTER (n = 1) AS own FROM l JOIN t USING (href) GROUP BY 1""")
def l11_outgoing_incoming(spark, sf_dir):
    """Each page's distinct targets, how often these are named by all pages, and how many no other page names."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(references.hrefs(F.col("html")))).alias("href"))
    named = links.groupBy("href").agg(F.count(F.lit(1)).alias("n"))
    return links.join(named, "href").groupBy("page_id").agg(F.count(F.lit(1)).alias("outgoing"), F.sum("n").alias("shared"), F.count_if(F.col("n") == 1).alias("own"))


@query(_REFERENCES + """ SELECT id, '[' || r1 || ']及び[' || r2 || ']第二項、[' || r3 || ']並びに[' || r4 || ']' AS shown, 7::BIGINT AS parts FROM p""")
def l13_split_by_links(spark, sf_dir):
    """Texts cut at their links."""
    texts = _texts(spark, sf_dir)
    spans = references.detected(texts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    cut = texts.join(spans, "id").select("id", references.split_by_spans("text", "spans").alias("p"))
    shown = F.array_join(F.transform("p", lambda x: F.when(x.linked, F.concat(F.lit("["), x.text, F.lit("]"))).otherwise(x.text)), "")
    return cut.select("id", shown.alias("shown"), F.size("p").cast("long").alias("parts"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS id, (l_partkey % 40)::BIGINT AS start, (l_partkey % 40 + l_suppkey % 9 + 1)::BIGINT AS "end", CASE WHEN l_linenumber <= 2 THEN 0 ELSE 1 END AS rank FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, start, "end") AS i FROM s),
g AS (SELECT id, 0::BIGINT AS i, NULL::BIGINT AS start, NULL::BIGINT AS "end", 0 AS rank, FALSE AS kept, []::STRUCT(a BIGINT, b BIGINT)[] AS claimed FROM (SELECT DISTINCT id FROM s)
 UNION ALL SELECT o.id, o.i, o.start, o."end", o.rank, k, CASE WHEN k THEN list_append(claimed, {'a': o.start, 'b': o."end"}) ELSE claimed END
 FROM (SELECT o.*, g.claimed, o.rank = 0 OR len(list_filter(g.claimed, lambda c: c.a < o."end" AND o.start < c.b)) = 0 AS k FROM g JOIN o ON o.id = g.id AND o.i = g.i + 1) o)
SELECT id, start, "end", rank FROM g WHERE kept""")
def u6_merged_spans(spark, sf_dir):
    """Spans of each order: those of its first two lines are stored and stay, others stay where nothing that stays overlaps them."""
    start = F.col("l_partkey") % 40
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + F.col("l_suppkey") % 9 + 1).alias("end"), F.when(F.col("l_linenumber") <= 2, 0).otherwise(1).alias("rank"))
    return references.without_overlap(s)


@query(_SEGMENTS + """, r AS (SELECT doc_id, path, count(*) AS n FROM s GROUP BY 1, 2) SELECT 'EMPTY_BODY' AS code, level AS node, count(*) AS n FROM s WHERE body = '' GROUP BY 1, 2
UNION ALL SELECT 'DUPLICATE_ANCHOR', 'fingerprint', count(*) FROM (SELECT 1 FROM s WHERE body <> '' GROUP BY doc_id, body HAVING count(*) > 1) UNION ALL SELECT 'DUPLICATE_PATH', 'path', count(*) FROM r WHERE n > 1""")
def v6_segment_checks(spark, sf_dir):
    """Segments with an empty body, by level; texts that stand twice in a law; paths that occur twice; numbers left in words, of which these laws have none."""
    return segments.checked(segments.segmented(_laws(spark, sf_dir)))


@query("""WITH a AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders), l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey) AS i FROM lineitem),
c AS (SELECT doc_id, sum(length('（order' || o_orderkey || '）')) AS n FROM a GROUP BY 1), b AS (SELECT doc_id, sum(length('part' || l_partkey)) AS n, sum(length(i::VARCHAR)) AS numbers FROM a JOIN l ON l_orderkey = o_orderkey GROUP BY 1)
SELECT doc_id, (c.n + coalesce(b.n, 0) + 11)::BIGINT AS captured, (c.n + coalesce(b.n, 0) + 11 + coalesce(b.numbers, 0))::BIGINT AS total, (c.n + coalesce(b.n, 0) + 11) / (c.n + coalesce(b.n, 0) + 11 + coalesce(b.numbers, 0)) < 0.95 AS low FROM c LEFT JOIN b USING (doc_id)""")
def v7_extraction(spark, sf_dir):
    """How much of each law's text is in segments, and where it is less than 95 per cent."""
    e = segments.extraction(_laws(spark, sf_dir))
    return e.select("doc_id", F.col("captured").cast("long").alias("captured"), F.col("total").cast("long").alias("total"), (F.col("rate") < 0.95).alias("low"))


_NODES = """WITH a AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders),
l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
f AS (SELECT sha256('{"caption":"","level":"chapter","num":"","text":"one","title":"one"}') AS c, sha256('{"caption":"","level":"appdx_table","num":"","text":"別表第二","title":"別表第二"}') AS x),
n AS (SELECT DISTINCT doc_id, 0 AS a, 0 AS i, 'chapter' AS level, 'main/chapter:fingerprint:' || c AS durable_key, 'root/chapter:1@1' AS legacy_key, '{"level":"chapter","text":"one","title":"one"}' AS content, '{"level":"chapter","title":"one"}' AS body FROM a, f
UNION ALL SELECT doc_id, a, 0, 'article', 'main/chapter:fingerprint:' || c || '/article:' || a, 'root/chapter:1@1/article:' || a || '@' || a,
 '{"caption":"（order ' || o_orderkey || '）","level":"article","number":"' || a || '","text":"（order ' || o_orderkey || '）"}', '{"caption":"（order ' || o_orderkey || '）","level":"article"}' FROM a, f
UNION ALL SELECT doc_id, a, i, 'paragraph', 'main/chapter:fingerprint:' || c || '/article:' || a || '/paragraph:' || i, 'root/chapter:1@1/article:' || a || '@' || a || '/paragraph:' || i || '@' || i,
 '{"level":"paragraph","number":"' || i || '","text":"' || i || '\\npart ' || l_partkey || '"}', '{"body":"part ' || l_partkey || '","level":"paragraph"}' FROM a JOIN l ON l_orderkey = o_orderkey, f
UNION ALL SELECT DISTINCT doc_id, 1000000000, 0, 'appdx_table', 'appendix/appdx_table:fingerprint:' || x, 'root/appdx_table:1@1', '{"level":"appdx_table","text":"別表第二"}', '{"level":"appdx_table"}' FROM a, f)"""


@query(_NODES + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a, i) - 1 AS source_index FROM n)
SELECT doc_id, source_index::INT AS source_index, CASE level WHEN 'article' THEN 0 WHEN 'paragraph' THEN max(CASE WHEN level = 'article' THEN source_index END) OVER (PARTITION BY doc_id ORDER BY source_index) END::INT AS parent_index, level, durable_key, legacy_key,
 sha256(content) AS content_checksum, sha256(body) AS body_checksum, CASE level WHEN 'article' THEN a WHEN 'paragraph' THEN i ELSE 1 END::INT AS sort_order, FALSE AS duplicate FROM r""")
def n17_parsed_nodes(spark, sf_dir):
    """Nodes of laws: their place and their parent's, keys that last and keys with places, checksums of their content and of their body alone."""
    found = nodes.parsed(_laws(spark, sf_dir), says=())
    return found.select("doc_id", "source_index", "parent_index", "level", "durable_key", "legacy_key", "content_checksum", "body_checksum", "sort_order", "duplicate")


def n11_normal_bodies(spark, sf_dir):
    """Every document's fingerprint after Unicode compatibility composition and with single spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(text.normal_body(F.col("text"))).alias("fingerprint"))


#: Unicode composition can't be written in SQL: held against plain Python in the tests.
QUERIES["n11_normal_bodies"] = n11_normal_bodies
