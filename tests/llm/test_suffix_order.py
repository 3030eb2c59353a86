"""The suffix order by a difference cover, and the repeats read off it, against plain forms."""

import random

import pytest

pytest.importorskip("folio.llm")
import brute  # noqa: E402
from folio.llm import suffix_order  # noqa: E402
from test_llm import corpus, frame, got  # noqa: E402

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_ranks(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(90))) for _ in range(12)] + ["a" * 70, "a" * 64, "ab" * 40, "", "é" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "sid long, text string")
    raw = [t.encode() for t in texts]
    found = suffix_order.suffix_ranks(df, 20).collect()
    assert sorted((x.sid, x.i) for x in found) == [(s, i) for s, b in enumerate(raw) for i in range(len(b))]
    heads = [raw[x.sid][x.i : x.i + 20] for x in sorted(found, key=lambda x: x.r)]
    assert heads == sorted(heads)
    of = {}
    for x in found:
        of.setdefault(x.r, set()).add(raw[x.sid][x.i : x.i + 20])
    assert all(len(v) == 1 for v in of.values())


def test_blocks_of_long_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_order, "BLOCK", 7)
    rows = corpus(4)[:40]
    assert got(suffix_order.removed_repeats(frame(spark, rows)), *COLUMNS) == brute.repeats(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats(spark, seed):
    rows = corpus(seed)
    assert got(suffix_order.removed_repeats(frame(spark, rows)), *COLUMNS) == brute.repeats(rows)


def test_edges(spark):
    schema = "doc_id long, text string, sid string, head int"
    assert suffix_order.removed_repeats(spark.createDataFrame([], schema)).count() == 0
    long = "x" * 60
    docs = spark.createDataFrame([(None, long, "1", 1), (1, long, None, 2), (1, long, "1", 2), (2, None, None, None), (3, "", "", 0)], schema)
    assert got(suffix_order.removed_repeats(docs), "doc_id", "n_removed") == [(None, 60), (1, 0), (1, 0), (2, 0), (3, 0)]
