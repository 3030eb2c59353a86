"""Every operator and every stage of the pipeline over awkward tables: nulls, empty and very long texts, ties, repeated rows, clashing columns, no rows."""

import sys
from pathlib import Path

import pytest

pytest.importorskip("folio.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from folio.llm import exact_dedup, language, quality  # noqa: E402
from folio.llm.queries import QUERIES, vocabulary  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

LONG = "".join(f"word{i % 977} and{i % 13} " for i in range(150_000))
#: Names that operators use for helper columns.
CLASH = ["n", "s", "keep", "probability", "host", "path", "p", "digest", "content", "hot", "key", "gone", "row", "folder", "held_out", "batch", "c0", "m0", "_keep", "_best", "_digest", "_gone", "_shard", "ids", "decoded"]
ITEM = "a passage of the benchmark that has exactly these twelve words in it"
ROWS = [
    (1, "the same text twice", "en", "a"), (2, "the  same text twice", "en", "a"), (3, "THE SAME TEXT TWICE", "en", None), (4, None, "en", "a"), (5, "", None, "b"),
    (6, " \t\n", "de", "b"), (7, LONG, "en", "a"), (8, LONG + "end", None, None), (9, f"before {ITEM} behind", "en", "c"), (10, "x", "fr", "c"),
    (11, "été déjà vu 日本語 🙂 text", "fr", "c"), (11, "été déjà vu 日本語 🙂 text", "fr", "c"), (None, "a row without an id", "en", "a"), (None, "a row without an id", "en", "a"), (None, None, None, None),
    (12, "one two three four five six seven eight nine", "en", "a"), (13, "one two three four five six seven eight nine", "en", "a"), (-5, "negative id", "en", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KINDS = {
    "labels": ("doc_id long, quality int, toxic int", [(1, 1, 0), (2, 1, 0), (10, 0, 0), (12, 1, 0), (None, 1, 0), (11, 0, 1), (11, 0, 1), (999, 1, 0), (5, None, None)]),
    "benchmark": ("item_id long, text string", [(1, ITEM), (2, None), (3, ""), (4, "x"), (None, "no id here but words"), (1, ITEM)]),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edges")
    for kind in ("awkward", "empty", "unlabelled"):
        rows = [] if kind == "empty" else [(*r, len(r[1] or "")) for r in ROWS]
        docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASH])
        docs.repartition(3).write.parquet(f"{base}/{kind}/documents.parquet")
        for name, (schema, rows) in KINDS.items():
            spark.createDataFrame([] if kind != "awkward" and name == "labels" or kind == "empty" else rows, schema).write.parquet(f"{base}/{kind}/{name}.parquet")
    return base


@pytest.mark.parametrize("kind", ["awkward", "empty", "unlabelled"])
@pytest.mark.parametrize("name", [q for q in QUERIES if q.split("_")[0] not in ("op11", "op12", "op13")])  # their tables: test_vectors.py, test_url_filter.py
def test_queries(spark, tables, name, kind):
    if kind == "unlabelled" and not name.startswith("op3"):
        return
    found = QUERIES[name](spark, f"{tables}/{kind}")
    rows = found.collect()
    if kind == "empty":
        assert rows == []
    elif name.split("_")[0] not in ("op6", "op9"):  # these two return what they find
        key = lambda x: (x is not None, x)
        assert sorted([r.doc_id for r in rows], key=key) == sorted([r[0] for r in ROWS], key=key)
    if name.startswith("op9") and kind == "awkward":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(9, 1), (9, 1), (10, 4)]
    if name.startswith("op3") and kind == "unlabelled":
        assert all(r.keep for r in rows)
    if name.startswith("op2") and kind == "awkward":
        texts = [(r[0], r[1]) for r in ROWS if r[0] not in (7, 8, None)]
        own = sorted(tuple(r)[:5] for r in rows if r.doc_id is not None and r.doc_id not in (7, 8))
        assert own == brute.repeats(texts)
        assert next(r for r in rows if r.doc_id == 8).n_removed == len(LONG.encode())


@pytest.mark.parametrize("kind", ["awkward", "empty", "unlabelled"])
def test_pipeline(spark, tables, kind):
    docs = spark.read.parquet(f"{tables}/{kind}/documents.parquet")
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs, stage(spark, docs, f"{tables}/{kind}")
        assert out.columns == before.columns, name
        assert {tuple(r) for r in out.collect()} <= given, name  # no column is overwritten
        docs = corpus_pipeline.written(out, f"edges-{name}")
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, f"{tables}/{kind}").collect()
    assert len(encoded) == docs.count()
    if kind == "unlabelled":
        left = [r.doc_id for r in encoded]
        assert 9 not in left and 10 not in left and {12, 7} <= set(left) and 13 not in left and left.count(11) == 1 and left.count(None) == 1


def test_run_of_the_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0 < len(found) < docs.count() and all(len(r.ids) == 4 * r.n_pieces for r in found)


def test_quality_posteriors_by_hand(spark):
    """Priors and posteriors of the hierarchy, from the operator's scores, in plain arithmetic."""
    rows = [(f"h{i % 3}", f"h{i % 3}/p{i % 7 % 2}", ((i * 37) % 100) / 100 * (0.5 + i % 3 / 4)) for i in range(90)] + [("rare", "rare/x", 0.05)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    priors = quality.priors(scored)

    def strength(groups, mean_of):
        n = sum(len(x) for x in groups.values())
        mean = sum(map(sum, groups.values())) / n
        within = sum(sum((v - sum(x) / len(x)) ** 2 for v in x) for x in groups.values())
        between = sum(len(x) * (sum(x) / len(x) - mean_of(g)) ** 2 for g, x in groups.items())
        noise = within / (n - len(groups))
        spread = (between - (len(groups) - 1) * noise) / (n - sum(len(x) ** 2 for x in groups.values()) / n)
        return min(max(mean * (1 - mean) / spread - 1, 1.0), 1e5) if spread > 0 else 1e5

    hosts, paths = {}, {}
    for h, p, x in rows:
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, p), []).append(x)
    mean = sum(x for _, _, x in rows) / len(rows)
    k = strength(hosts, lambda h: mean)
    site = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
    k2 = strength(paths, lambda g: site[g[0]])
    assert priors.mean == pytest.approx(mean) and priors.strength == pytest.approx(k2)
    found = quality._decided(quality._met(scored, priors), priors, 0.5).collect()
    assert len(found) == len(rows)
    for r in found:
        x = paths[r.host, r.path]
        path = (sum(x) - r.p + k2 * site[r.host]) / (len(x) - 1 + k2)
        odds = min(max(r.p, 1e-9), 1 - 1e-9)
        odds = odds / (1 - odds) * path / (1 - path) / (mean / (1 - mean))
        assert r.site_posterior == pytest.approx(site[r.host]) and r.path_posterior == pytest.approx(path) and r.probability == pytest.approx(odds / (1 + odds))
    assert site["rare"] > 0.05 + (mean - 0.05) * 0.3  # a sparse site is drawn towards the mean


def test_quality_by_hierarchy_beats_the_text_alone(spark):
    """Every third text says nothing, but its site does: held-out labels of rows that the model was not fitted to."""
    rows, labels = [], []
    for i in range(1200):
        good = i % 4 < 2
        host = f"good{i % 8}" if good else f"bad{i % 8}"
        text = "a line of WORDS !" if i // 4 % 3 == 0 else "a calm line of plain words" if good else "WIN $$ FREE!! 100 %% " * 3
        rows.append((i, text, host))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fitted = spark.createDataFrame([x for x in labels if x[0] % 5 == 0], "doc_id long, quality int")
    found = quality.classify(docs, fitted, host=docs["source"], path=docs["source"]).collect()
    truth = dict(labels)
    held = [r for r in found if r.doc_id % 5]
    alone = sum((r.evidence >= 0.5) == truth[r.doc_id] for r in held) / len(held)
    whole = sum(r.keep == truth[r.doc_id] for r in held) / len(held)
    assert whole > alone + 0.1


@pytest.mark.parametrize("digest", [exact_dedup._sha256, lambda c: c[:1]])
@pytest.mark.parametrize("hot", [2, 10_000])
def test_kept_documents(spark, digest, hot):
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None] + [(100 + i, "twelve copies") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted({(r[0], r[1]) for r in brute.exact(rows)})
    found = exact_dedup.exact_dedup(docs, digest=digest, limit=400, hot_rows=hot)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()) == sorted(r[:4] for r in brute.exact(rows))
    kept = exact_dedup.kept_documents(docs, digest=digest, limit=400, hot_rows=hot).collect()
    assert sorted(r.doc_id for r in kept) == sorted({k for _, k in want})


def test_language_keeps_ids(spark):
    assert language.identify(spark.createDataFrame([(None, None)], "doc_id long, text string"), None).collect()[0].lang_pred == "und"
    assert vocabulary("piece_bpe_32k.model")
