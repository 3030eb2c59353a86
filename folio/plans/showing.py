"""What readers are shown: runs of a text with their places, units, formulas and tables, over texts made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import display, references, segments, text
from folio.plans.parsing import _N, _kanji, _numbers
from folio.plans.registering import Register
from folio.tables import table

query = Register()
QUERIES, ORACLES = query.queries, query.oracles

_K = f"SELECT *, {_kanji('n')} AS kn, {_kanji('m')} AS km FROM ({_N})"


def _spelt(spark, sf_dir):
    """_numbers and a text with two of them: a width with its unit, and a part of a whole."""
    n = _numbers(spark, sf_dir).withColumn("kn", text.to_kanji(F.col("n"))).withColumn("km", text.to_kanji(F.col("m")))
    return n.withColumn("text", F.concat(F.lit("幅"), "kn", F.lit("平方メートル以上で"), "kn", F.lit("分の"), "km", F.lit("の（Ａ）")))


_FORMS = (("kind", "第", "種"), ("grade", "", "級"), ("year", "昭和", "年"), ("number", "第", "号"), ("article", "第", "条"), ("law", "法律第", "号"), ("amount", "約", "個"))


@query(f"""WITH k AS ({_K}) SELECT p_partkey, unnest([{", ".join(f"{{'form': '{f}', 'shown': '{a}' || {'m' if f in ('article', 'law', 'amount') else 'km'} || '{b}'}}" for f, a, b in _FORMS)}], recursive := true) FROM k""")
def n30_worded(spark, sf_dir):
    """Numerals that the words around them leave as they are written, and others."""
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.concat(F.lit(a), "km", F.lit(b)).alias("text")) for f, a, b in _FORMS]))
    rows = _spelt(spark, sf_dir).select("p_partkey", forms.alias("x")).select("p_partkey", "x.form", display.tokens(F.col("x.text")).alias("found"))
    return rows.select("p_partkey", "form", display.shown(F.col("found")).alias("shown"))


@query(f"""WITH k AS ({_K}), t AS (SELECT p_partkey, unnest([
  {{'place': 0, 'shown': '幅', 'kind': 'plain', 'size': 1}}, {{'place': 1, 'shown': format('{{:,}}', n), 'kind': 'number', 'size': length(kn)}}, {{'place': 2, 'shown': 'm²', 'kind': 'unit', 'size': 6}},
  {{'place': 3, 'shown': '以上で', 'kind': 'plain', 'size': 3}}, {{'place': 4, 'shown': m || '/' || format('{{:,}}', n), 'kind': 'fraction', 'size': length(kn) + 2 + length(km)}}, {{'place': 5, 'shown': 'の(A)', 'kind': 'plain', 'size': 4}}], recursive := true) FROM k)
SELECT p_partkey, place, (sum(size) OVER w - size)::INT AS "start", (sum(size) OVER w)::INT AS "end", shown, kind FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY place)""")
def n31_display_runs(spark, sf_dir):
    """The runs of a text, a row for each, with their places in it."""
    rows = _spelt(spark, sf_dir).select("p_partkey", F.posexplode(display.tokens("text")).alias("place", "x"))
    return rows.select("p_partkey", "place", "x.*")


@query(f"""WITH k AS ({_K}) SELECT p_partkey, '幅' || format('{{:,}}', n) || 'm²以上で' || m || '/' || format('{{:,}}', n) || 'の(A)' AS shown, format('{{:,}}', n) || 'm²' AS width,
  1 AS number_start, (1 + length(kn))::INT AS number_end, NULL::INT AS beyond FROM k""")
def n32_places(spark, sf_dir):
    """What is shown for places of the text, and the places behind what is shown."""
    rows = _spelt(spark, sf_dir).select("p_partkey", display.tokens("text").alias("found"), (F.length("kn") + 7).alias("behind"))
    number, beyond = display.source_of(F.col("found"), F.lit(1), F.lit(2)), display.source_of(F.col("found"), F.lit(1000), F.lit(1001))
    rows = rows.select("p_partkey", display.shown(F.col("found")).alias("shown"), display.shown(F.col("found"), 1, F.col("behind")).alias("width"), number.alias("x"), beyond.alias("y"))
    return rows.select("p_partkey", "shown", "width", F.col("x.start").alias("number_start"), F.col("x.end").alias("number_end"), F.col("y.start").alias("beyond"))


@query(f"""WITH k AS ({_K}), u AS (SELECT unnest([{", ".join(f"{{'name': '{a}', 'sign': '{b}'}}" for a, b in display.UNITS.items())}], recursive := true))
SELECT p_partkey, name, format('{{:,}}', n) || sign AS counted, 'プロ' || name AS other FROM k, u""")
def n33_units(spark, sf_dir):
    """Units have a sign behind a quantity, and stay within words."""
    rows = _spelt(spark, sf_dir).select("p_partkey", "kn", F.explode(F.array(*map(F.lit, display.UNITS))).alias("name"))
    counted, other = (display.shown(display.tokens(F.concat(x, "name"))) for x in (F.col("kn"), F.lit("プロ")))
    return rows.select("p_partkey", "name", counted.alias("counted"), other.alias("other"))


@query(f"""WITH n AS ({_N}) SELECT p_partkey, 'V' AS "left", n || '+(h)' AS above, '(' || m || ')(d)' AS below, NULL::VARCHAR AS none, '次の式' AS introduction, 'V=' || n AS formula, 'この式において、Vは、' || m AS definitions FROM n""")
def n34_formulas(spark, sf_dir):
    """Formulas over and under a stroke, and formulas on lines of their own with the meanings of their signs."""
    n, m = F.col("n").cast("string"), F.col("m").cast("string")
    split = display.formula_parts(F.concat(F.lit("V=（"), n, F.lit("+(h)）／("), m, F.lit(")(d)")))
    laid = display.formula_layout(F.concat(F.lit("次の式\nV="), n, F.lit("\n（この式において、Vは、"), m, F.lit("）")))
    rows = _numbers(spark, sf_dir).select("p_partkey", split.alias("x"), display.formula_parts(F.concat(F.lit("V="), n)).alias("y"), laid.alias("z"))
    return rows.select("p_partkey", "x.*", F.col("y.left").alias("none"), "z.*")


def _cells(spark, sf_dir):
    """A table for each supplier: four lines of two cells; the first cell spans two lines, the last of line 3 two columns."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("table_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("line"))
    s = s.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    label, body = F.format_string("(%d)", "line"), F.repeat(F.lit("x"), (F.col("table_id") % 400 + 1).cast("int"))
    rows, columns = (F.col("line") == 1) & (F.col("place") == 0), (F.col("line") == 3) & (F.col("place") == 1)
    return s.select("table_id", "line", "place", F.when(F.col("place") == 0, label).otherwise(body).alias("text"), F.when(columns, 2).otherwise(1).alias("colspan"), F.when(rows, 2).otherwise(1).alias("rowspan"))


@query("""WITH s AS (SELECT s_suppkey AS table_id, repeat('x', (s_suppkey % 400 + 1)::BIGINT) AS x FROM supplier)
SELECT table_id, unnest([{'line': 1, 'column': 0, 'text': '(1)'}, {'line': 1, 'column': 1, 'text': x}, {'line': 2, 'column': 0, 'text': ''}, {'line': 2, 'column': 1, 'text': '(2)'}, {'line': 2, 'column': 2, 'text': x},
  {'line': 3, 'column': 0, 'text': '(3)'}, {'line': 3, 'column': 1, 'text': x}, {'line': 3, 'column': 2, 'text': x}, {'line': 4, 'column': 0, 'text': '(4)'}, {'line': 4, 'column': 1, 'text': x}], recursive := true) FROM s""")
def n39_grid(spark, sf_dir):
    """The cells of tables at their columns."""
    return display.table_grid(_cells(spark, sf_dir))


@query("""WITH s AS (SELECT s_suppkey AS table_id, s_suppkey % 400 + 1 AS n FROM supplier), w AS (SELECT *, CASE WHEN n <= 4 THEN 'symbol' ELSE 'body' END AS kind, CASE WHEN n <= 4 THEN 1 ELSE least(16, greatest(4, sqrt(n))) END AS w FROM s)
SELECT table_id, 0 AS "column", 'symbol' AS kind, round(100 / (1 + 2 * w), 9) AS percent FROM w UNION ALL SELECT table_id, unnest([1, 2]), kind, round(100 * w / (1 + 2 * w), 9) FROM w""")
def n39_columns(spark, sf_dir):
    """Kinds and shares of the width of the columns of tables."""
    c = display.column_layout(display.table_grid(_cells(spark, sf_dir)))
    return c.withColumn("percent", F.round("percent", 9))


@query(f"""WITH n AS ({_N}) SELECT p_partkey, n || '_' || m AS cited, n::VARCHAR AS plain, '別表' AS other, NULL::VARCHAR AS none FROM n""")
def n9_cited_numbers(spark, sf_dir):
    """Numbers of cited articles, with and without their words."""
    cited = F.concat(F.lit(" 第"), "kn", F.lit("条の"), "km", F.lit(" "))
    return _spelt(spark, sf_dir).select("p_partkey", *[text.cited_number(c).alias(k) for k, c in (("cited", cited), ("plain", F.col("n").cast("string")), ("other", F.lit("別表")), ("none", F.lit(" 条")))])


@query("""SELECT p_partkey, unnest([{'place': 0, 'amend': p_brand, 'extract': p_partkey % 2 = 0, 'label': '附則', 'title': '附則（' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN '・抄' ELSE '' END || '）'},
  {'place': 1, 'amend': NULL, 'extract': false, 'label': '附　則', 'title': '制定時附則'}], recursive := true) FROM part""")
def n23_supplements(spark, sf_dir):
    """The supplementary provisions of laws in XML with their titles."""
    a = F.concat(F.lit('<Law><LawBody><SupplProvision Extract="'), (F.col("p_partkey") % 2 == 0).cast("string"), F.lit('" AmendLawNum=" '), "p_brand", F.lit('">\n<SupplProvisionLabel>附則</SupplProvisionLabel></SupplProvision>'))
    xml = F.concat(a, F.lit('<SupplProvision AmendLawNum=""><SupplProvisionLabel> 附　則 </SupplProvisionLabel></SupplProvision></LawBody></Law>'))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(segments.supplements(xml)).alias("place", "x")).select("p_partkey", "place", "x.*")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'solid' ELSE 'none' END AS top, 'none' AS "right", 'solid' AS bottom, 'none' AS "left", greatest(1, p_size % 4)::INT AS colspan, 1 AS rowspan FROM part""")
def n24_cell_styles(spark, sf_dir):
    """Borders and spans of the cells of tables."""
    tag = F.concat(F.lit('<TableColumn BorderTop="'), F.when(F.col("p_partkey") % 3 == 0, "solid").otherwise("none"), F.lit('" BorderLeft="dotted" BorderBottom="solid" rowspan="x" colspan="'), (F.col("p_size") % 4).cast("string"), F.lit('">'))
    return table(spark, sf_dir, "part").select("p_partkey", segments.cell_style(tag).alias("x")).select("p_partkey", "x.*")


@query(r"""SELECT doc_id, regexp_replace(text, '[\x09-\x0D\x20\x{3000}\x{00A0}\x{FEFF}]+', '', 'g') AS joined FROM documents""")
def n37_joined_up(spark, sf_dir):
    """All documents without white space."""
    return table(spark, sf_dir, "documents").select("doc_id", text.joined_up(F.col("text")).alias("joined"))


@query("""WITH l AS (SELECT s_suppkey AS id, s_name AS name, 'S' || s_suppkey AS short FROM supplier), a AS (SELECT 'S' || s_suppkey AS name, s_suppkey + 1 AS id FROM supplier WHERE s_suppkey % 3 = 0),
  r AS (SELECT name, id, 0 AS rank FROM a UNION ALL SELECT short, id, 1 FROM l UNION ALL SELECT name, id, 2 FROM l)
SELECT name, arg_min(id, rank * 1000000000 + id) AS id FROM r WHERE name IS NOT NULL GROUP BY name""")
def l6_names_of_laws(spark, sf_dir):
    """Every name, short name and alias with what it stands for."""
    s = table(spark, sf_dir, "supplier")
    laws = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("S"), "s_suppkey").alias("short"))
    return references.names_of(laws, s.filter("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), (F.col("s_suppkey") + 1).alias("id")))


_WAYS = {"前条": "'art' || (n - 1)", "次条": "'art' || (n + 1)", "同条": "'art' || n", "本条": "'art' || n", "前項": "'art' || n || '/para' || (m - 1)", "次項": "'art' || n || '/para' || (m + 1)", "同項": "'art' || n || '/para' || m || '/item1'", "前二項": "NULL"}


@query(f"""WITH n AS ({_N}), t AS (SELECT p_partkey, unnest([{", ".join(f"{{'word': '{w}', 'path': {p}}}" for w, p in _WAYS.items())}], recursive := true) FROM n) SELECT p_partkey, word, path, NULL::VARCHAR AS nowhere FROM t""")
def l8_relative_paths(spark, sf_dir):
    """Where relative words lead to from a path; nowhere from outside articles."""
    here = F.concat(F.lit("art"), F.col("n").cast("string"), F.lit("/para"), F.col("m").cast("string"), F.lit("/item1"))
    rows = _numbers(spark, sf_dir).select("p_partkey", here.alias("here"), F.explode(F.array(*map(F.lit, _WAYS))).alias("word"))
    return rows.select("p_partkey", "word", references.relative_path(F.col("word"), F.col("here")).alias("path"), references.relative_path(F.col("word"), F.lit("suppl/para2")).alias("nowhere"))


@query(f"""WITH n AS ({_N}) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'art' || n WHEN 1 THEN 'art' || n || '-' || m || '/para2' WHEN 2 THEN 'art' || n || '/para1/item3' ELSE 'art' || n || '-' || m || '/para2/item3' END AS path,
  CASE p_partkey % 4 WHEN 0 THEN 'art' || n || '/para1' WHEN 2 THEN 'art' || n || '/item3' END AS alternate FROM n""")
def l9_implied_paragraphs(spark, sf_dir):
    """Paths of citations, the first paragraph implied, and what else they may mean."""
    kind = F.col("p_partkey") % 4
    x = references.cited_paths(F.col("n"), F.when(kind % 2 == 1, F.col("m")), F.when(kind % 2 == 1, 2), F.when(kind >= 2, 3))
    return _numbers(spark, sf_dir).select("p_partkey", x.alias("x")).select("p_partkey", "x.path", F.get("x.alternates", F.lit(0)).alias("alternate"))
