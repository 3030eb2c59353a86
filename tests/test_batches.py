"""Batches of found rows stay small whatever one batch of inputs gives; what segments tell of each other in one pass."""

import pyarrow as pa
from folio.functions import scan, segments
from folio.plans.parsing import QUERIES


class Rows:
    """Enough of a table for scanned, which gives its function and schema back."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, f, schema):
        return f


def test_found_rows_are_given_on_in_small_batches(spark):
    schema = spark.createDataFrame([], "k long, n int").schema
    f = scan.scanned(Rows(schema), ["n"], ["k"], lambda n: [(i,) for i in range(n)], "i int")
    given = pa.RecordBatch.from_pydict({"k": list(range(2000)), "n": [i % 21 for i in range(2000)]})
    batches = list(f(iter([given])))
    assert max(b.num_rows for b in batches) < 4096 + 21
    found = [x for b in batches for x in zip(b.column("k").to_pylist(), b.column("i").to_pylist())]
    assert found == [(k, i) for k in range(2000) for i in range(k % 21)]


def test_each_segment_has_one_above(spark):
    """Paths that stand twice give no row twice: the one around counts."""
    xml = '<Law><MainProvision>' + '<Article Num="1"><Paragraph Num="1"><Sentence>a</Sentence></Paragraph></Article>' * 2 + "</MainProvision></Law>"
    found = segments.segmented(spark.createDataFrame([(1, xml)], "doc_id int, xml string")).orderBy("sequence").collect()
    assert [(r.sequence, r.path, r.above) for r in found] == [(1, "art1", None), (2, "art1/para1", 1), (3, "art1", None), (4, "art1/para1", 3)]
    told = {(r.code, r.node): r.n for r in segments.checked(segments.segmented(spark.createDataFrame([(1, xml), (2, None)], "doc_id int, xml string"))).collect()}
    assert told == {("DUPLICATE_PATH", "path"): 2, ("DUPLICATE_ANCHOR", "fingerprint"): 1, ("EMPTY_BODY", "Article"): 2}


def test_extraction_reads_each_text_once(spark):
    """Titles of several parts, texts without segments, unreadable ones and none at all."""
    rows = [
        (1, '<Law>out<Article Num="1"><ArticleTitle> a <Ruby>b</Ruby>c</ArticleTitle><ArticleCaption>no</ArticleCaption><Paragraph><Sentence> d e </Sentence><Rt>f</Rt></Paragraph></Article></Law>'),
        (2, "<Law>none</Law>"), (3, "<Law><Article>x"), (4, None), (5, "<Law/>"),
    ]
    found = segments.extraction(spark.createDataFrame(rows, "doc_id int, xml string"))
    assert {r.doc_id: (r.total, r.captured, r.rate) for r in found.collect()} == {1: (11, 3, 3 / 11), 2: (4, None, 0.0), 3: (1, 0, 0.0), 4: (None, None, None), 5: (0, None, None)}
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and "Join" not in found._jdf.queryExecution().toString()


def test_laws_are_put_together_without_lambdas(spark):
    """A sort with a comparing lambda is interpreted, pair by pair."""
    assert "lambda" not in QUERIES["n18_durable_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
