"""Groups of any size: interval sweeps, digests of lists, percentiles and scopes with many ranges, against brute force and on hot keys."""

import datetime as dt
import hashlib
import random

import duckdb
import pytest
from folio.operators import digest, intervals, ranking, scope, temporal
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_intervals(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), r.choice([None, *range(20)]), r.choice([None, None, *range(20)]), i) for i in range(120)]
    points = [(k, p) for k in "abcd" for p in range(-1, 21)]
    held = {(k, p): [i for key, s, e, i in rows if key == k and s is not None and s <= p and (e is None or p < e)] for k, p in points}
    found = intervals.at_points(spark.createDataFrame(rows, "k string, s int, e int, v long"), spark.createDataFrame(points, "k string, p int"), ["k"], "s", "e", "p", "v").collect()
    assert {(x.k, x.p): (x.matches, x.v) for x in found} == {kp: (len(h), h[0] if len(h) == 1 else None) for kp, h in held.items()} and len(found) == len(points)


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_spans(spark, seed):
    r = random.Random(seed)

    def spans(n):
        return [(r.choice("ab"), i, s := r.choice([None, *range(20)]), None if s is None else s + r.choice([-1, 0, 1, 3, 9])) for i in range(n)]

    a, b = spans(60), spans(80)
    schema = "k string, i int, s int, e int"
    found = intervals.overlap_counts(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "i", "s", "e").collect()
    fine = [x for x in a if x[2] is not None and x[2] <= x[3]]
    want = {(k, i): sum(k == k2 and s2 is not None and s2 <= e2 and s2 < e and s < e2 for k2, _, s2, e2 in b) for k, i, s, e in fine}
    got = {(x.k, x.i): x.n for x in found}
    assert set(got) == {(k, i) for k, i, _, _ in fine}
    # a span of no length counts what begins before it and ends behind it
    assert got == {(k, i): sum(k == k2 and s2 is not None and s2 <= e2 and s2 < e for k2, _, s2, e2 in b) - sum(k == k2 and s2 is not None and s2 <= e2 and e2 <= s for k2, _, s2, e2 in b) for k, i, s, e in fine}
    assert all(got[k, i] == want[k, i] for k, i, s, e in fine if s < e)


def test_a_key_with_100_000_intervals(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("s"), (F.col("id") + 3).alias("e"), F.col("id").alias("v"))
    found = intervals.at_points(rows, spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("p")), ["k"], "s", "e", "p", "v")
    assert found.groupBy("matches").count().orderBy("matches").collect() == [(1, 1), (2, 1), (3, n - 2)]
    counts = intervals.overlap_counts(rows, rows, ["k"], "v", "s", "e")
    assert counts.agg(F.sum("n")).first()[0] == 5 * n - 6


def test_versions_as_asked(spark):
    day = lambda n: dt.date(2024, 1, n)
    versions = spark.createDataFrame([("a", day(1), day(5), 1), ("a", day(4), None, 2), ("b", day(3), day(4), 3)], "k string, valid_from date, valid_to date, v long")
    asked = spark.createDataFrame([("a", day(n)) for n in (1, 4, 5, 5)] + [("b", day(2)), ("b", day(3)), ("c", day(3))], "k string, day date")
    found = {(x.k, x.day.day): (x.outcome, x.matches, x.v) for x in temporal.as_asked(versions, asked, "k", "v").collect()}
    assert found == {("a", 1): ("resolved", 1, 1), ("a", 4): ("ambiguous", 2, None), ("a", 5): ("resolved", 1, 2), ("b", 2): ("out_of_range", 0, None), ("b", 3): ("resolved", 1, 3)}


def plain_digest(texts, fan):
    now = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    while True:
        now = [hashlib.sha256("".join(now[i : i + fan]).encode()).hexdigest() for i in range(0, len(now), fan)]
        if len(now) == 1:
            return now[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_digests_do_not_depend_on_partitions(spark, parts):
    rows = [("a" if i % 40 else None, i, f"t{i}" if i % 7 else None) for i in range(300)] + [("one", 0, "x")]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(parts)
    found = {x.g: x.version for x in digest.listed(df, ["g"], ["i"], F.col("t"), fan=5).collect()}
    assert found == {g: plain_digest([t for k, i, t in sorted(rows, key=lambda x: x[1]) if k == g], 5) for g in ("a", None, "one")}
    whole = digest.listed(df.filter("g = 'a'"), [], ["i"], F.col("t"), fan=5).collect()
    assert [x.version for x in whole] == [found["a"]]
    assert digest.listed(df.filter("false"), ["g"], ["i"], F.col("t")).count() == 0


def test_digest_of_two_levels_equals_its_sql(spark):
    """A list longer than fan * fan rows: SQL hashes all hashes of the first level as one."""
    rows = [(g, i, f"t{i}") for g, n in (("long", 130), ("short", 20), ("one", 5)) for i in range(n)]
    found = {x.g: x.version for x in digest.listed(spark.createDataFrame(rows, "g string, i int, t string"), ["g"], ["i"], F.col("t"), fan=5, levels=2).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE l (g VARCHAR, i INT, t VARCHAR)")
    c.executemany("INSERT INTO l VALUES (?, ?, ?)", rows)
    assert found == dict(c.execute(digest.sql("l", "g", "i", "t", fan=5)).fetchall())


def test_texts_of_lists_in_pieces(spark):
    rows = [("a" if i % 40 else None, i, f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, t string").repartition(7)
    found = {x.g: x.keys for x in digest.joined(df, ["g"], ["i"], F.col("t"), ",", fan=5).collect()}
    assert found == {g: ",".join(t for k, _, t in rows if k == g) for g in ("a", None)}


def test_percentiles_of_a_hot_group(spark):
    r = random.Random(4)
    rows = [("hot" if i % 10 else None, r.choice([None, *range(5000)])) for i in range(20_000)] + [("one", 7), ("none", None)]
    found = ranking.percentiles(spark.createDataFrame(rows, "g string, v int").repartition(6), ["g"], "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()
    want = {}
    for g in ("hot", None, "one"):
        own = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = tuple(own[max(1, -(-int(p * 100) * len(own) // 100)) - 1] for p in (0, 0.5, 0.99, 1))
    assert {x.g: tuple(x)[1:] for x in found} == want


def test_an_entry_with_10_000_ranges(spark):
    articles = spark.createDataFrame([(1, "l", 1, "a/b5/c", None), (2, "l", 1, "a/b50000", None), (3, "l", 1, "a/b5x", None), (4, "l", 2, "a/b5", None), (5, "l", 1, "a/b7", "gone"), (6, "m", 1, "z", None), (7, "l", 1, "a/b9", None), (8, "n", 1, "a/b9", None)], "id long, law_id string, revision long, key string, deleted_at string")
    laws = spark.createDataFrame([("l", 1), ("m", 1), ("n", 1)], "law_id string, current long")
    entries = spark.createDataFrame([("e1", "l", "excerpt", "verified"), ("e2", "l", "excerpt", "verified"), ("e3", "m", "excerpt", "draft"), ("e4", "m", "full", "verified")], "entry_id string, law_id string, mode string, status string")
    ranges = spark.range(10_000).select(F.lit("e1").alias("entry_id"), F.concat(F.lit("a/b"), "id").alias("top")).unionByName(spark.createDataFrame([("e2", "a/b9"), ("e1", "a/b5/c")], "entry_id string, top string"))
    found = scope.visible(articles, laws, entries, ranges)
    assert sorted(x.id for x in found.collect()) == [1, 6, 7] and found.columns == articles.columns
    assert "LeftSemi" in found._jdf.queryExecution().toString()
    assert spark.createDataFrame([("a/b/c",), ("",), ("a",)], "k string").select(scope.prefixes(F.col("k"))).collect() == [(["a", "a/b", "a/b/c"],), ([""],), (["a"],)]
