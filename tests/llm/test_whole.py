"""The classifier's features and fit, shards that split, and the pipeline as a whole, against plain forms."""

import math
import random
import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

pytest.importorskip("folio.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import sentencepiece  # noqa: E402
from folio.llm import quality, sharding  # noqa: E402
from folio.llm.queries import vocabulary  # noqa: E402
from folio.llm.shared import Texts  # noqa: E402
from test_llm import corpus  # noqa: E402

SYMBOL = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lowered = [bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in words]
    upper, lower, digit = (sum(a <= b <= z for b in data) for a, z in ((65, 90), (97, 122), (48, 57)))
    other, symbol = sum(b >= 128 for b in data), sum(b in SYMBOL for b in data)
    marks = [sum(b in SYMBOL for b in w) for w in words]
    some, many, letters = max(len(words), 1), max(len(data), 1), max(upper + lower + other, 1)
    return [
        math.log1p(len(words)), sum(map(len, words)) / some, upper / letters, digit / many, symbol / many, data.count(b"\n") / many,
        sum(a == b for a, b in zip(lowered, lowered[1:])) / some, sum(m == len(w) for m, w in zip(marks, words)) / some, sum(m >= 2 for m in marks) / some,
        len(set(lowered)) / some, len(set(lowered)) / math.sqrt(some), float(upper / letters > 0.5), float(not words), other / many,
    ]


def test_features_of_texts():
    texts = [t for _, t in corpus(9)] + ["SHOUT SHOUT shout", "!!! a-b-c $$$ x", "line\nline\n\n", "été ÉTÉ", "\x0b\x0c a"]
    raw = [(t or "").encode() for t in texts]
    laid = Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert np.abs(quality.features(laid) - np.array([features(t) for t in texts])).max() < 1e-9


def test_fit_is_the_optimum_with_its_ridge():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4)) * [1, 5, 0.1, 2] + 3
    y = (r.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 3)))).astype(float)

    def loss(model, weights):
        z = np.hstack([(x - model.mean) / model.scale, np.ones((300, 1))]) @ weights
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (weights[:-1] ** 2).sum() + 0.5e-6 * weights[-1] ** 2

    model = quality.fit(x, y)
    best = loss(model, model.weights)
    for i in range(5):
        for step in (-1e-3, 1e-3):
            assert loss(model, model.weights + step * np.eye(5)[i]) > best
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0)) and quality.fit(x, np.ones(300)) is None


@pytest.mark.parametrize("limit", [300_000, 20_000, 1_500])
def test_shards_that_split_against_sql(spark, limit):
    """The registered query's SQL, at limits that split the small table's shards."""
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = c.execute(sharding.oracle(limit))
    names = [x[0] for x in found.description]
    own = sharding.assign_shards(spark.read.parquet(f"{sf}/documents.parquet"), limit=limit)
    rows = sorted(tuple(r) for r in own.select(*names).collect())
    assert rows == sorted(found.fetchall()) and len({r[names.index("shard")] for r in rows}) >= min(900, 2_400_000 / limit)


def kept_by_quality(rows, labels):
    """rows (doc, text, lang, source) that the classifier keeps: the model from the labelled rows, posteriors by site and path."""
    x = np.array([features(t) for _, t, _, _ in rows])
    at = {d: i for i, (d, _, _, _) in enumerate(rows)}
    model = quality.fit(x[[at[d] for d, _ in labels if d in at]], np.array([float(q) for d, q in labels if d in at]))
    p = model.probability(x)
    host = [s or "" for _, _, _, s in rows]
    path = ["/".join(v for v in (s, lang) if v is not None) for _, _, lang, s in rows]
    hosts, paths = {}, {}
    for h, w, v in zip(host, path, p):
        hosts.setdefault(h, []).append(v)
        paths.setdefault((h, w), []).append(v)
    mean = min(max(p.mean(), 1e-4), 1 - 1e-4)

    def strength(groups, prior):
        n, k = len(rows), len(groups)
        if k < 2 or n <= k:
            return 10.0
        m = min(max(p.mean(), 1e-6), 1 - 1e-6)
        noise = max(sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()), 0) / (n - k)
        between = sum(len(v) * (np.mean(v) - prior(g)) ** 2 for g, v in groups.items())
        spread = (between - (k - 1) * noise) / max(n - sum(len(v) ** 2 for v in groups.values()) / n, 1.0)
        return min(max(m * (1 - m) / spread - 1, 1.0), 1e5) if spread > 0 else 1e5

    k = strength(hosts, lambda g: mean)
    site = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k2 = strength(paths, lambda g: site[g[0]])
    out = []
    for row, h, w, v in zip(rows, host, path, p):
        own = paths[h, w]
        post = min(max((sum(own) - v + k2 * site[h]) / (len(own) - 1 + k2), 1e-4), 1 - 1e-4)
        odds = math.log(min(max(v, 1e-9), 1 - 1e-9) / (1 - min(max(v, 1e-9), 1 - 1e-9))) + math.log(post / (1 - post)) - math.log(mean / (1 - mean))
        if 1 / (1 + math.exp(-odds)) >= 0.5:
            out.append(row)
    return out


def test_pipeline_against_its_stages_in_plain_form(spark, tmp_path):
    r = random.Random(12)
    items = [(i, " ".join(f"item{i}word{j}" for j in range(12))) for i in range(4)] + [(9, None)]
    rows = []
    for i, t in corpus(12, n=50):
        good = i % 3 > 0
        text = t if good or not t else f"BUY NOW!!! $$$ {t.upper()} 100%"
        if i % 11 == 5 and good:
            text = f"{t or ''} words before {items[i % 4][1]} and words behind it"
        rows.append((i, text, r.choice(["en", "de", None]), f"site{i % 3}" if i % 7 else None))
    labels = [(i, int(i % 3 > 0)) for i, *_ in rows if i % 2]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = kept_by_quality(rows, labels)
    first = {d for d, keep, _, kept, _ in brute.exact([x[:2] for x in good]) if kept}
    single = [x for x in good if x[0] in first]
    alone = {d for d, _, c in brute.components([x[:2] for x in single]) if d == c}
    near = [x for x in single if x[0] in alone]
    bad = {doc for doc, _ in brute.contaminated([x[:2] for x in near], [x for x in items if x[1]])}
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = {d: library.encode(t or "") for d, t, _, _ in near if d not in bad}
    found = {x.doc_id: np.frombuffer(x.ids, "<u4").tolist() for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == want
    # each stage has something to do
    assert len(rows) > len(good) > len(single) > len(near) > len(want) > 10
