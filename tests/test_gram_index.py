"""The kept index of character pairs against plain search, over generations."""

import random

import pyarrow as pa
from folio.operators import gram_index

SCHEMA = "id long, body string"


def plain(texts, term):
    return {d: [i for i in range(len(t)) if t.startswith(term, i)] for d, t in texts.items() if t and term in t}


def found(spark, path, term):
    return {r.doc: r.places for r in gram_index.search(spark, path, term).collect()}


def test_phrases_over_generations(spark, tmp_path):
    r, path = random.Random(1), f"file://{tmp_path}/index"
    assert gram_index.search(spark, path, "x").count() == 0 and gram_index.generations(spark, path) == 0
    letters = "aab b防火🙂\n\0"
    texts = {i: "".join(r.choice(letters) for _ in range(r.randrange(30))) for i in range(60)} | {100: None, 101: "", 102: "a", 103: "aaaa"}
    terms = ["a", "🙂", "aa", "aaa", "b防", "防火🙂", "ab b", "\0a", "zz", "aab b防火", "火"] + ["".join(r.choice(letters) for _ in range(n)) for n in (2, 2, 3, 3, 4)]
    gram_index.add(spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3), path, doc="id", text="body")
    for term in terms:
        assert found(spark, path, term) == plain(texts, term), repr(term)
    changed = {1: "防火 new", 2: None, 500: "aab"}
    gram_index.add(spark.createDataFrame(list(changed.items()), SCHEMA), path, doc="id", text="body", gone=spark.createDataFrame([(3,), (4,)], "doc long"))
    texts |= changed
    texts[3] = texts[4] = None
    for term in terms[:6]:
        assert found(spark, path, term) == plain(texts, term), repr(term)
    gram_index.add(spark.createDataFrame([(3, "防火 again")], SCHEMA), path, doc="id", text="body")
    texts[3] = "防火 again"
    assert found(spark, path, "防火") == plain(texts, "防火") and gram_index.generations(spark, path) == 3


def test_a_search_reads_its_own_folders(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    gram_index.add(spark.createDataFrame([(i, f"text number {i}") for i in range(50)], SCHEMA), path, doc="id", text="body")
    plan = gram_index.search(spark, path, "number")._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters:")[1].split("]")[0] and "In(gram" in plan
    # a generation whose table of documents is missing is not seen
    spark.createDataFrame([(7, "nu", [0])], "doc long, gram string, places array<int>").write.parquet(f"{path}/postings/generation=1/folder=0")
    assert len(found(spark, path, "number")) == 50


def test_postings_leave_in_small_batches():
    """Whatever one batch of texts gives; batches of few texts are put together."""
    texts = [None if i % 50 == 0 else f"text {i} " * (i % 30) for i in range(600)]
    given = [pa.RecordBatch.from_pydict({"doc": list(range(a, a + 300)), "text": pa.array(texts[a : a + 300], pa.string())}) for a in (0, 300)]
    batches = list(gram_index._postings(iter(given), limit=1000))
    sizes = [len(b.column("places").flatten()) for b in batches]
    assert max(sizes) < 1000 + max(len(t or "") for t in texts) and min(sizes[:-1]) >= 1000
    found = {(r["doc"], p): r["gram"] for b in batches for r in b.to_pylist() for p in r["places"]}
    assert found == {(d, i): t[i : i + 2] for d, t in enumerate(texts) if t for i in range(len(t))}
