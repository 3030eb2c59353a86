"""Text functions, segments, citations, spans, state and streams on small cases of our own."""

import datetime as dt
from collections import Counter
from datetime import date

import pytest
from folio.functions import display, numerals, references, segments, text
from folio.operators import state, temporal, tree, usage
from folio.streaming import activity, versions
from pyspark.sql import functions as F

XML = """<Law><MainProvision><Chapter Num="1"><ChapterTitle>First</ChapterTitle>
<Article Num="1"><ArticleCaption>(Aim)</ArticleCaption><ArticleTitle>Article 1</ArticleTitle><Paragraph Num="1"><ParagraphNum>１</ParagraphNum><Sentence>The  aim.</Sentence>
<Item Num="1"><ItemTitle>一</ItemTitle><Sentence>An item.</Sentence></Item></Paragraph></Article>
<Article Num="52_2"><ArticleTitle>Article 52-2</ArticleTitle><Paragraph Num="1"><Sentence>Branch.</Sentence></Paragraph></Article></Chapter></MainProvision>
<SupplProvision AmendLawNum="A1"><Article Num="1"><Paragraph Num="1"><Sentence>Starts now.</Sentence></Paragraph></Article></SupplProvision>
<SupplProvision AmendLawNum="A2"><Article Num="1"><Paragraph Num="1"><Sentence>Starts later.</Sentence></Paragraph></Article></SupplProvision></Law>"""


def test_segments_have_their_own_addresses(spark):
    raw = spark.createDataFrame([("d", XML), ("broken", "<a>"), ("none", None)], "doc_id string, xml string")
    rows = segments.segmented(raw).orderBy("doc_id", "sequence").collect()
    paths = [r.path for r in rows if r.doc_id == "d" and r.level == "Article"]
    assert paths == ["art1", "art52-2", "suppl:A1/art1", "suppl:A2/art1"]
    body = {r.path: r.body_normalized for r in rows if r.doc_id == "d"}
    assert body["art1/para1"] == "The aim." and body["art1/para1/item1"] == "An item."
    assert [r.error is not None for r in rows if r.doc_id == "broken"] == [True]
    assert not [r for r in rows if r.doc_id == "none"]


def test_numerals(spark):
    back = spark.range(1, 10000).withColumn("k", text.to_kanji(F.col("id"))).select("id", *[f(F.col("k")).cast("long").alias(n) for n, f in (("a", numerals.reader_number), ("b", numerals.segment_number), ("c", numerals.citation_number))])
    assert back.filter("id <> a or id <> b or id <> c or a is null or b is null").count() == 0
    keys = spark.createDataFrame([("第五十二条の二",), ("第3条",), ("前文",)], "s string").select(text.article_key("s").alias("k")).collect()
    assert [r.k for r in keys] == ["52_2", "3", None]


def test_normalisation(spark):
    df = spark.createDataFrame([("Ａ ｂ\n\tc  ",), (None,)], "s string")
    assert [r[0] for r in df.select(text.normal_body(F.col("s"))).collect()] == ["A b c", None]
    assert df.select(text.half_width(F.col("s"))).first()[0].startswith("A b")
    assert df.select(text.slug(F.lit("A b--C!"))).first()[0] == "a-b-c"
    assert df.select(text.share_of(F.lit("ab12"), "[0-9]")).first()[0] == 0.5
    a, b = (df.select(text.context_checksum(F.lit(t), F.lit(12), F.lit(15))).first()[0] for t in ("0123456789ABxyzCD", "!!0123456789ABxyzCD"))
    assert a != b


def test_citations_and_spans(spark):
    spans = spark.createDataFrame([(1, 0, 5, 0), (1, 3, 8, 1), (1, 9, 12, 1), (1, 10, 14, 1)], "id long, start int, end int, rank int")
    assert sorted(r.start for r in references.without_overlap(spans).collect()) == [0, 9]
    # a span that is dropped claims nothing
    spans = spark.createDataFrame([(1, 0, 10, 1), (1, 5, 15, 1), (1, 12, 20, 1), (2, 3, 9, 0), (2, 5, 7, 0), (2, 0, 3, 1), (2, 8, 9, 1)], "id long, start int, end int, rank int")
    assert sorted((r.id, r.start) for r in references.without_overlap(spans).collect()) == [(1, 0), (1, 12), (2, 0), (2, 3), (2, 5)]
    # a span without bounds is none; texts without an id are one text
    spans = spark.createDataFrame([(1, None, 4, 0), (1, 2, None, 1), (None, 1, 3, 1), (None, 2, 5, 1), (1, 2, 3, 1)], "id long, start int, end int, rank int")
    assert {(r.id, r.start) for r in references.without_overlap(spans).collect()} == {(None, 1), (1, 2)}


def test_bigrams(spark):
    df = spark.createDataFrame([("aab\U0001f600b",), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.bigrams(F.col("t"))).collect()] == [["aa", "ab", "b\U0001f600", "\U0001f600b"], [], [], []]


def test_versions_as_asked(spark):
    day = lambda x: date(2000, 1, x)
    v = spark.createDataFrame([("a", 1, day(1), day(5)), ("a", 2, day(5), None), ("b", 3, day(3), day(4)), ("b", 4, day(2), day(9))], "key string, v int, valid_from date, valid_to date")
    asked = spark.createDataFrame([("a", day(4)), ("a", day(5)), ("b", day(3)), ("b", day(9)), ("b", day(9))], "key string, day date")
    found = {(r.key, r.day.day): (r.outcome, r.v, r.last_day) for r in temporal.as_asked(v, asked, "key", "v").collect()}
    assert found == {("a", 4): ("resolved", 1, None), ("a", 5): ("resolved", 2, None), ("b", 3): ("ambiguous", None, day(9)), ("b", 9): ("out_of_range", None, day(9))}
    listed = {(r.key, r.day.day): (r.outcome, r.v, r.last_day) for r in temporal.as_of(v, [day(4), day(5), day(3), day(9)], "key", "v").collect()}
    assert found.items() <= listed.items() and len(listed) == 8


def test_rows_with_one_key(spark):
    old = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 3), ("a", 2), ("b", 9), ("b", 8)], "id string, v int")
    assert sorted(map(tuple, state.upserted(old, new, ["id"]).collect())) == [("a", 2), ("b", 8)]
    assert sorted(map(tuple, state.upserted(old, new, ["id"], [F.desc("v")]).collect())) == [("a", 3), ("b", 9)]
    assert sorted(map(tuple, state.inserted(old, new, ["id"]).collect())) == [("a", 1), ("b", 8)]


def test_packs_of_any_size(spark):
    rows = [(1, i) for i in range(230)] + [(2, i) for i in range(0, 230, 5)] + [(3, 7)] + [(1, 3)]
    found = usage.pack_counts(spark.createDataFrame(rows, "pack long, item long"))
    assert found.count() == 230 * 229 and found.filter("n = 2").count() == 46 * 45 and found.filter("n > 2").count() == 0


def test_more_pairs_are_counted_by_more_tasks(spark):
    rows = [(p, (p * i) % 40 if i else None) for p in range(30) for i in range(20)] + [(None, 1), (None, 2)]
    packs = spark.createDataFrame(rows, "pack int, item int")
    held = {p: {i for q, i in rows if q == p and i is not None} for p in range(30)}
    counts = Counter((a, b) for own in held.values() for a in own for b in own if a != b)
    found, n = usage._counted(packs, block=5, pairs=10)
    assert n == -(-sum(len(x) * (len(x) - 1) // 2 for x in held.values()) // 10) > 100
    assert {(r.item, r.related): r.n for r in found.collect()} == counts and found.count() == len(counts)
    best = {(a, r + 1): b for a in range(40) for r, b in enumerate(sorted((b for x, b in counts if x == a), key=lambda b: (-counts[a, b], b))[:3])}
    assert {(r.item, r.rank): r.related for r in usage.cold_start(packs, 3, pairs=10).collect()} == best
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_state(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    assert sorted(map(tuple, state.upserted(old, new, ["id"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(map(tuple, state.inserted(old, new, ["id"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    pointers = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "id string, current string")
    wanted = spark.createDataFrame([("x", "1", "2"), ("y", "0", "2")], "id string, expected string, next string")
    assert sorted(map(tuple, state.swapped(pointers, wanted).collect())) == [("x", "2", "moved"), ("y", "1", "conflict"), ("z", "1", "kept")]


def test_calendar_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-2-1",), (None,)], "s string")
    assert [r[0] for r in df.select(temporal.calendar_date(F.col("s"))).collect()] == [dt.date(2024, 2, 29), None, None, None]


def streamed(spark, tmp_path, df, f, name, mode="append"):
    df.write.parquet(str(tmp_path / "in"))
    with activity.rocks_db(spark):
        q = f(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    return spark.table(name)


def test_streamed_pairs_equal_the_batch(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    views = ev.select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("item"))
    batch = usage.cooccurrences(ev.select(F.col("user_id").alias("user"), "ts", F.col("event_id").alias("tie"), F.get_json_object("props", "$.k").alias("item")))
    found = streamed(spark, tmp_path, views.coalesce(1), activity.consecutive_pairs, "pairs").groupBy("item", "related").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_pairs_of_many_rows(spark, tmp_path):
    """A user whose views come in several frames, out of order and at equal times; views without an item, a time or a user."""
    start, n = dt.datetime(2024, 1, 1), 25_000
    rows = [(1, start + dt.timedelta(minutes=10 * (i // 2)), -i, str(i % 7) if i % 11 else None) for i in range(n)] + [(u, start, 0, "a") for u in (2, 3, None)] + [(2, None, 0, "b"), (3, start, 1, "c"), (None, start, 1, "c"), (3, start + dt.timedelta(minutes=31), 2, "d")]
    df = spark.createDataFrame(rows, "user long, ts timestamp, tie long, item string").orderBy(F.hash("tie")).coalesce(1)
    found = Counter(map(tuple, streamed(spark, tmp_path, df, activity.consecutive_pairs, "many").groupBy("user", "item", "related").count().collect()))
    want = Counter()
    for u in (1, 2, 3, None):
        own = sorted((ts, tie, item) for user, ts, tie, item in rows if user == u and ts is not None)
        want.update((u, a[2], b[2]) for a, b in zip(own, own[1:]) if a[2] and b[2] and a[2] != b[2] and b[0] - a[0] <= dt.timedelta(minutes=30))
    assert found == Counter((*k, c) for k, c in want.items())


def test_streamed_windows(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streamed(spark, tmp_path, ev, lambda s: activity.counts(s), "hours", "complete")
    assert found.agg(F.sum("events")).first()[0] == ev.count()


def test_streamed_deliveries(spark, tmp_path):
    rows = spark.createDataFrame([("s", "h1", dt.datetime(2024, 1, 1)), ("s", "h1", dt.datetime(2024, 1, 1)), ("s", "h2", dt.datetime(2024, 1, 1))], "source_id string, content_hash string, ts timestamp")
    assert streamed(spark, tmp_path, rows, lambda s: activity.first_deliveries(s, ["source_id", "content_hash"]), "deliveries").count() == 2


def test_runs_of_texts(spark):
    shown = {
        "二十・五メートル": "20.5m", "〇・〇〇三": "0.003", "零下二〇度": "零下20度", "一億八千万円": "1億8,000万円", "万一": "1万1", "百貨店の五": "百貨店の五", "一定の五": "一定の五", "二号の三": "二号の三",
        "昭和二十五年法律第二百二号": "昭和25年法律第202号", "第二条第三項第四号": "第2条第3項第四号", "前条の二に五百": "前条の2に500", "毎時五キロメートルプログラム": "毎時5kmプログラム", "（１）Ａ": "(1)A", "一二十": "一二十",
        "千分の七": "7/1,000", "風速三メートル毎秒": "風速3m/秒", "一立方メートルにつきキログラム": "kg/m³", "": "", "😀二": "😀2", None: None,
    }
    df = spark.createDataFrame([(k,) for k in shown], "text string").withColumn("found", display.tokens("text"))
    rows = df.select("text", "found", display.shown(F.col("found")).alias("shown")).collect()
    assert {r.text: r.shown for r in rows} == shown
    for r in rows:
        if r.text is not None:  # the runs are the whole text, one behind the other, plain ones never side by side
            assert "".join(r.text[t.start : t.end] for t in r.found) == r.text and all(a.end == b.start for a, b in zip(r.found, r.found[1:]))
            assert not any(a.kind == b.kind == "plain" for a, b in zip(r.found, r.found[1:]))


def test_formulas(spark):
    texts = ["Ａ＝(ａ)(ｂ)／（ｃ）", "a=b", "a=b／c／d", "b／c", "a=／c", "a=()／c", None, "x\n（この式において、ａ）", "次の\na=b", "次の\nA=b\n(この式において、\nｃ)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", display.formula_parts(F.col("t")).alias("x"), display.formula_layout(F.col("t")).alias("y"))
    rows = {r.t: r for r in df.collect()}
    assert {t: tuple(r.x) for t, r in rows.items() if r.x} == {texts[0]: ("Ａ", "(ａ)(ｂ)", "ｃ")}
    assert {t: tuple(r.y) for t, r in rows.items() if r.y} == {texts[-1]: ("次の", "A=b", "この式において、\nｃ")}


def test_table_grids(spark):
    rows = [(1, 1, 1, "a", 2, 2), (1, 1, 2, None, 1, 1), (1, 2, 1, "b", 1, 3), (1, 4, 1, "d", None, None), (2, 7, 1, "五", 0, 0)]
    cells = spark.createDataFrame(rows, "table_id long, line int, place int, text string, colspan int, rowspan int")
    cells = cells.fillna(1, ["colspan", "rowspan"])
    grid = display.table_grid(cells)
    found = {(r.table_id, r.line, r.column): r.text for r in grid.collect()}
    assert found == {(1, 1, 0): "a", (1, 1, 1): "a", (1, 1, 2): "", (1, 2, 0): "", (1, 2, 1): "", (1, 2, 2): "b", (1, 4, 0): "d", (1, 4, 2): "", (2, 7, 0): "五"}
    kinds = {(r.table_id, r.column): (r.kind, round(r.percent, 6)) for r in display.column_layout(grid).collect()}
    assert kinds[2, 0] == ("numeric", 100.0) and abs(sum(p for (t, _), (_, p) in kinds.items() if t == 1) - 100) < 1e-6
    assert display.table_grid(cells.limit(0)).count() == 0


def test_supplements_styles_and_numbers(spark):
    xml = ["<Law/>", None, "", "<SupplProvision><P/></SupplProvision>", '<SupplProvision Extract="false" AmendLawNum="A"> <SupplProvisionLabel x="1">L</SupplProvisionLabel></SupplProvision>']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xml)], "i int, x string")
    found = {r.i: r.s for r in df.select("i", segments.supplements(F.col("x")).alias("s")).collect()}
    assert found[0] == found[2] == found[3] == [] and not found[1]
    assert [tuple(s) for s in found[4]] == [("A", False, "L", "附則（A）")]
    tags = ['<TableColumn rowspan="-3" colspan="2px" BorderRight="solid">', "<TableColumn>", '<TableColumn colspan="99999999999">']
    styles = spark.createDataFrame([(t,) for t in tags], "t string").select(segments.cell_style(F.col("t")).alias("s")).collect()
    assert [tuple(r.s)[:4] for r in styles] == [("none", "solid", "none", "none"), ("none",) * 4, ("none",) * 4]
    assert [(r.s.colspan, r.s.rowspan) for r in styles] == [(2, 1), (1, 1), (999999999, 1)]
    texts = {"第二百六条": "206", "第213条の2": "213_2", "206": "206", "条": None, None: None, " ": None, "附則": "附則"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.cited_number(F.col("t")).alias("n"), text.joined_up(F.col("t")).alias("j")).collect()
    assert {r.t: r.n for r in rows} == texts and {r.t: r.j for r in rows}[" "] == ""


def test_paths_beside(spark):
    df = spark.createDataFrame([("前条", "art5-2"), ("前項", "art5"), ("次項", "art5/para2"), ("同項", "art5/para2"), ("前条", None), ("前各号", "art5")], "w string, h string")
    assert [r.p for r in df.select(references.relative_path(F.col("w"), F.col("h")).alias("p")).collect()] == ["art4", None, "art5/para3", "art5/para2", None, None]
    laws = spark.createDataFrame([(1, "A", "a"), (2, "B", "a"), (3, "A", None)], "id long, name string, short string")
    aliases = spark.createDataFrame([("B", 9)], "name string, id long")
    assert {tuple(r) for r in references.names_of(laws, aliases).collect()} == {("A", 1), ("a", 1), ("B", 9)}


def test_versions_after_each_batch(spark, tmp_path):
    """Each batch's differences lead from one digest to the next, which is that of all rows so far."""
    batches = [[1, 2, 2, 5], [2, 7], [1, 1, 1, 9, 5], []]
    so_far, told = [], str(tmp_path / "told")
    with activity.rocks_db(spark):
        for n, batch in enumerate(batches):
            spark.createDataFrame([(x,) for x in batch], "doc long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = versions.changes(spark.readStream.schema("doc long").parquet(str(tmp_path / "in")), "doc")
            # each batch by a query of its own that goes on from the state of the one before
            stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            so_far += batch
            want = {}
            for d in set(so_far):
                digest, documents = want.get(d % 2, (0, 0))
                want[d % 2] = digest ^ versions.bits(d, so_far.count(d)), documents + 1
            found = {r.part: (r.version, r.documents) for r in versions.versions(spark.read.schema("document long, change long, new long").parquet(told), F.col("document") % 2).collect()}
            assert found == want, n
