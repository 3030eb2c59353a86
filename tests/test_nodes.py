"""Nodes of laws in XML: keys, occurrences, texts and errors."""

import hashlib
import json

import pyarrow as pa
import pytest
from folio.functions import nodes, scan
from test_batches import Rows

LAW = """<Law Era="Showa" Year="25" PromulgateMonth="5" PromulgateDay="24"><LawBody><LawTitle>t</LawTitle><MainProvision>
<Chapter Num="1"><ChapterTitle>第一章　総則</ChapterTitle>
<Article Num="2_3"><ArticleCaption>（用語）</ArticleCaption><ArticleTitle>第二条の三</ArticleTitle>
<Paragraph Num="1"><ParagraphNum/><ParagraphSentence><Sentence>用語<Ruby>漢<Rt>かん</Rt></Ruby>字</Sentence></ParagraphSentence>
<Item Num="1"><ItemTitle>一</ItemTitle><ItemSentence><Column Num="1"><Sentence>A</Sentence></Column><Column Num="2"><Sentence>B</Sentence></Column></ItemSentence><Subitem1 Num="1"><Subitem1Title>イ／ロ</Subitem1Title><Subitem1Sentence>s</Subitem1Sentence></Subitem1></Item></Paragraph>
<Paragraph Num="2"><ParagraphNum>２</ParagraphNum><TableStruct><Table><TableRow><TableColumn>x</TableColumn><TableColumn>x</TableColumn></TableRow><TableRow><TableColumn>y</TableColumn></TableRow></Table></TableStruct></Paragraph></Article>
<Article Num="9"><Paragraph Num="1"><ParagraphNum>1</ParagraphNum></Paragraph></Article><Article Num="9"/></Chapter></MainProvision>
<SupplProvision><SupplProvisionLabel>附　則</SupplProvisionLabel><Article Num="1"/></SupplProvision>
<SupplProvision AmendLawNum="平成五年法律第 八号"><SupplProvisionLabel>附則</SupplProvisionLabel><Paragraph Num="1"><ParagraphNum>1</ParagraphNum></Paragraph></SupplProvision>
<AppdxTable Num="1"><AppdxTableTitle>別表</AppdxTableTitle></AppdxTable></LawBody></Law>"""


def test_nodes_of_a_law(spark):
    raw = spark.createDataFrame([("d", LAW), ("broken", "<Law>"), ("none", None), ("empty", "<Law/>")], "doc_id string, xml string")
    found = nodes.parsed(raw).orderBy("doc_id", "source_index").collect()
    assert [(r.doc_id, r.source_index, r.durable_key, bool(r.error)) for r in found if r.doc_id != "d"] == [("broken", None, None, True)]
    own = {r.source_index: r for r in found if r.doc_id == "d"}
    short = [r.durable_key.replace("main/chapter:1", "~") for r in own.values()]
    article = "~/article:2の3"
    assert short[:7] == ["~", article, f"{article}/paragraph:1", f"{article}/paragraph:1/item:一", f"{article}/paragraph:1/item:一/column:1", f"{article}/paragraph:1/item:一/column:2", f"{article}/paragraph:1/item:一/subitem1:イ%2Fロ"]
    assert short[7] == f"{article}/paragraph:2" and short[8].startswith(f"{article}/paragraph:2/table_struct:fingerprint:")
    cells = [k for k in short if "/table_column:" in k]
    assert len(cells) == 3 and len(set(cells)) == 3 and sum("occurrence:" in k.rsplit("/table_column", 1)[1] for k in cells) in (0, 2)
    assert [k for k in short if k.startswith("~/article:9")] == ["~/article:9/occurrence:1", "~/article:9/occurrence:1/paragraph:1", "~/article:9/occurrence:2"]
    assert [r.duplicate for r in own.values() if r.durable_key.startswith("main/chapter:1/article:9") and r.level == "article"] == [True, True]
    assert [k for k in short if k[0] in "sa"] == [
        "supplementary/suppl_provision:promulgated:Showa-25-5-24", "supplementary/suppl_provision:promulgated:Showa-25-5-24/article:1",
        "supplementary/suppl_provision:平成五年法律第八号", "supplementary/suppl_provision:平成五年法律第八号/paragraph:1", "appendix/appdx_table:1",
    ]
    assert own[2].legacy_key == "root/chapter:1@1/article:2の3@1/paragraph:1@1" and own[4].legacy_key.endswith("/item:一@1/column:1@1")
    assert own[2].text == "用語漢字" and own[1].caption == "（用語）" and own[1].text == "（用語）\n第二条の三" and own[1].number == "2の3" and own[0].title == "第一章　総則"
    assert own[2].parent_index == 1 and own[3].parent_index == 2 and own[7].parent_index == 1 and own[7].sort_order == 2
    supplement = next(r for r in own.values() if r.level == "article" and r.durable_key.startswith("suppl"))
    assert supplement.number == "附則1_1" and [r.title for r in own.values() if r.level == "suppl_provision"] == ["附　則", "附則"]


def test_keys_stay_when_siblings_come_and_go(spark):
    def keys(articles):
        xml = "<Law><LawBody><MainProvision>" + "".join(f'<Article Num="{n}"><Paragraph Num="1"><ParagraphNum>1</ParagraphNum><Sentence>text {n}</Sentence></Paragraph></Article>' for n in articles) + "</MainProvision></LawBody></Law>"
        return {r.durable_key: (r.content_checksum, r.body_checksum, r.legacy_key) for r in nodes.parsed(spark.createDataFrame([(1, xml)], "doc_id long, xml string")).collect()}

    a, b = keys([1, 2, 3]), keys([0, 1, 3])
    assert set(a) & set(b) == {f"main/article:{n}{p}" for n in (1, 3) for p in ("", "/paragraph:1")}
    assert all(a[k][:2] == b[k][:2] for k in set(a) & set(b)) and a["main/article:1"][2] != b["main/article:1"][2]


def test_nodes_of_a_law_need_no_shuffle(spark):
    """They stand together as the parser gives them: a shuffle of all they say was twenty times the input on disk."""
    raw = spark.createDataFrame([("d", LAW)], "doc_id string, xml string")
    plan = nodes.parsed(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and plan.count("MapInArrow") == 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_are_seen_whole_whatever_the_batches(spark, size):
    rows = [(k, i) for k in range(9) for i in (range(k) if k else [None])] * 2
    schema = spark.createDataFrame([], "k long, i int").schema
    f = scan.together(Rows(schema), "i", ["k", "i"], ["k", "i"], lambda k, i: ([len(k)] * len(k), [set(k) == {k[0]}] * len(k)), "n int, one boolean")
    given = [pa.RecordBatch.from_pylist([{"k": k, "i": i} for k, i in rows[at : at + size]], pa.schema([("k", pa.int64()), ("i", pa.int32())])) for at in range(0, len(rows), size)]
    batches = list(f(iter([given[0].slice(0, 0), *given])))
    found = [x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("k", "i", "n", "one")))]
    assert found == [(k, i, k or 1, True) for k, i in rows]
    assert max(b.num_rows for b in batches) <= size + 8


def test_nodes_that_are_not_together_are_no_law():
    with pytest.raises(ValueError, match="in order"):
        nodes._keys([0, 2], [None, 0], ["main"] * 2, ["article"] * 2, ["article:1", "article:2"], ["a", "b"])


def test_what_has_no_number_goes_by_what_it_says(spark):
    """After compatibility composition and with single spaces; of equal siblings each has its occurrence, and those below them follow."""
    table = "<Table><TableRow><TableColumn><Sentence>{}</Sentence></TableColumn></TableRow></Table>"
    xml = '<Law><MainProvision><Chapter><ChapterTitle>Ａ　１</ChapterTitle></Chapter><Chapter><ChapterTitle>A 1</ChapterTitle></Chapter><Article Num="１"><ArticleCaption>x</ArticleCaption></Article>' + table.format("ｙ") + table.format("y") + "</MainProvision></Law>"
    found = nodes.parsed(spark.createDataFrame([(1, xml)], "doc_id int, xml string")).orderBy("source_index").collect()

    def print_of(**said):
        return "fingerprint:" + hashlib.sha256(json.dumps(dict(caption="", num="", text="", title="") | said, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    chapter, cells = print_of(level="chapter", text="A 1", title="A 1"), [print_of(level=f"table{x}") for x in ("", "_row")]
    column = print_of(level="table_column", text="y")
    tables = [f"main/table:{cells[0]}/occurrence:{n}" for n in (1, 2)]
    assert [r.durable_key for r in found] == [
        f"main/chapter:{chapter}/occurrence:1", f"main/chapter:{chapter}/occurrence:2", "main/article:1",
        *[x for t in tables for x in (t, f"{t}/table_row:{cells[1]}", f"{t}/table_row:{cells[1]}/table_column:{column}")],
    ]
    assert [r.duplicate for r in found] == [True, True, False, True, False, False, True, False, False]
    assert found[0].content_checksum != found[1].content_checksum and found[0].title == "Ａ　１"
