"""Vector codes and whitening against plain forms, over awkward tables too."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("folio.llm")
from folio.llm import vector_codes, whitening  # noqa: E402
from folio.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, row string, y int, m long, d int, code string"


def fine(rows):
    """Usable rows of the most frequent length, of equally frequent ones the least."""
    some = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in some)
    size = min(sizes, key=lambda n: (-sizes[n], n)) if some else 0
    return [r for r in some if len(r[1]) == size]


def codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    own = [(r[0], [max(-(2**31) + 1, min(2**31 - 1, math.floor(scale * float(np.float32(x))))) for x in r[1]], r[2]) for r in fine(rows)]
    if not own:
        return []
    size = len(own[0][1])
    edges = [j * size // parts for j in range(parts + 1)]
    first = sorted(own, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in zip(edges, edges[1:])]

    def near(part, book):
        return min((sum((x - c) ** 2 for x, c in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for j, (a, b) in enumerate(zip(edges, edges[1:])):
            held = defaultdict(list)
            for _, y, _ in own:
                held[near(y[a:b], books[j])[1]].append(y[a:b])
            books[j] = [[sum(c) // len(held[i]) for c in zip(*held[i])] if i in held else e for i, e in enumerate(books[j])]
    out, by_label = [], Counter()
    for v, y, label in own:
        best = [near(y[a:b], books[j]) for j, (a, b) in enumerate(zip(edges, edges[1:]))]
        out.append((v, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(v, c, e, by_label[label], digest) for v, c, e, label in out]


def table_of(spark, rows):
    more = [(*r, "x", 1, 2, 3, "y") for r in rows]
    return spark.createDataFrame(more, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def same(df, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def awkward(seed, n=90, d=8, spread=1.0):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, spread, d)], int(i % 3) if i % 5 else None) for i in r.permutation(n) - n // 2]
    rows += [(1000 + i, rows[0][1], 1) for i in range(n)]  # one part holds half of all rows
    rows += [rows[1], rows[2], (None, rows[3][1], None), (None, rows[4][1], 2)]
    rows += [(2000, None, 1), (2001, [1.0] * (d - 1) + [None], 1), (2002, [float("nan")] * d, 1), (2003, [float("inf")] * d, None), (2004, [1.0], 1), (2005, [], 1), (2006, [-0.0] * d, 1)]
    return rows


@pytest.mark.parametrize("seed,d,entries", [(1, 8, 256), (2, 8, 5), (3, 6, 7), (4, 3, 16), (5, 4, 1)])
def test_codes(spark, seed, d, entries):
    rows = awkward(seed, d=d)
    df = table_of(spark, rows)
    found = vector_codes.compress(df, vec_id=df["vec_id"], vector=df["embedding"], label=df["label"], entries=entries)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    same(found, codes(rows, entries=entries))


def test_codes_of_large_numbers_are_exact(spark):
    rows = awkward(6, n=12, d=4, spread=40_000.0)
    df = table_of(spark, rows)
    same(vector_codes.compress(df, vec_id=df["vec_id"], vector=df["embedding"], label=df["label"], entries=4), codes(rows, entries=4))


def test_nearest_takes_the_first_of_equals():
    entries = np.array([[2, 0], [0, 0], [0, 0], [4, 0]])
    for most in (10, 1 << 30):
        at, away = vector_codes.nearest(np.array([[1, 0], [3, 0], [0, 0]]), entries, most)
        assert at.tolist() == [0, 0, 1] and away.tolist() == [1, 1, 0]


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [float("nan")], 1)]])
def test_nothing_usable(spark, rows):
    df = table_of(spark, rows)
    for found in (vector_codes.compress(df, vec_id=df["vec_id"], vector=df["embedding"], label=df["label"]), whitening.whiten(df, vec_id=df["vec_id"], vector=df["embedding"])):
        assert found.collect() == []


def test_codes_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = c.execute(ORACLES["op11_vector_codes"])
    names = [x[0] for x in found.description]
    df = QUERIES["op11_vector_codes"](spark, SF)
    assert sorted(df.columns) == sorted(names)
    same(df.select(*names), found.fetchall())


def plain_whitening(rows, components=32):
    """Integers, rows and components as numpy has them."""
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in rows], object)
    n = len(x)
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    centred = ((n * x - x.sum(axis=0)) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    order = order[values[order] > 1e-11 * values.max()][:components]
    return deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("seed,d", [(1, 8), (2, 40), (3, 130)])
def test_whitening(spark, seed, d):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, np.linspace(0.3, 3, d))], 1) for i in range(300)]
    for row in rows:  # two equal dimensions: one component less
        row[1][1] = row[1][0]
    rows += [rows[0], rows[7]]
    bad = [(2000, None, 1), (2001, [1.0] * (d - 1) + [None], 1), (2002, [float("nan")] * d, 1), (2004, [1.0], 1)]
    df = table_of(spark, rows + bad)
    found = whitening.whiten(df, vec_id=df["vec_id"], vector=df["embedding"]).collect()
    deviation, white, explained = plain_whitening(rows)
    k = white.shape[1]
    assert k == min(32, d - 1) and len(found) == len(rows) * k
    for i in {x.vec_id: None for x in found}:
        own = sorted((x for x in found if x.vec_id == i), key=lambda x: x.component)
        assert [x.component for x in own[:: len(own) // k]] == list(range(1, k + 1)) and {x.deviation for x in own} == {deviation[i]} and {x.n for x in own} == {len(rows)}
    where = {x[0]: i for i, x in enumerate(rows[:300])}
    got = np.zeros((300, k))
    for x in found:
        got[where[x.vec_id], x.component - 1] = x.whitened
    sign = np.sign((got * white[:300]).sum(axis=0))
    assert np.abs(got * sign - white[:300]).max() < 1e-6
    by = {x.component: x.explained for x in found}
    assert [by[i + 1] for i in range(k)] == pytest.approx(list(explained), rel=1e-6)
    error = {x.identity_error for x in found}
    assert len(error) == 1 and 0 <= error.pop() < 1e-6
    assert np.abs(np.cov(np.vstack([got, got[[0, 7]]]).T, bias=True) - np.eye(k)).max() < 1e-6


def test_whitening_with_an_outlier(spark):
    """Products beyond a long: Python's integers; a deviation beyond a long is null."""
    r = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 1, 5)], 1) for i in range(400)] + [(999, [2e7, 0.0, 0.0, 0.0, 0.0], 1)]
    df = table_of(spark, rows)
    found = whitening.whiten(df, vec_id=df["vec_id"], vector=df["embedding"]).collect()
    deviation, _, _ = plain_whitening(rows)
    want = {row[0]: (int(x) if x < 1 << 63 else None) for row, x in zip(rows, deviation)}
    assert {x.vec_id: x.deviation for x in found} == want and None in want.values()


def test_equal_rows_have_no_component(spark):
    df = table_of(spark, [(i, [1.0, 2.0], 1) for i in range(9)])
    assert whitening.whiten(df, vec_id=df["vec_id"], vector=df["embedding"]).collect() == []


def test_query_of_whitening(spark):
    found = QUERIES["op12_whitening"](spark, SF).toPandas()
    assert len(found) == 500 * 32 and found.identity_error.max() < 1e-9
