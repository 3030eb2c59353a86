"""Stored trees, pointers by doubling and numbers without groups in one task, against plain forms."""

import random

import pytest
from folio.operators import pointers, ranking, tree_index
from folio.plans import reading
from folio.sources import stored
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NODES = [("a", None, 0), ("b", "a", 0), ("c", "a", 1), ("d", "b", 0), ("x", "y", 0), ("y", "x", 0), ("v", "x", 3), ("z", "none", 0), ("e", "a", 1), ("f", None, 0)]


def frame(spark, nodes):
    return spark.createDataFrame(nodes, "id string, parent string, place int").repartition(3)


def plain(nodes):
    """id -> (depth, ancestors, path, root, first, last, number) by recursion."""
    below, out, seen = {}, {}, {}
    for n, parent, place in nodes:
        below.setdefault(parent, []).append((place, n))

    def walk(n, place, above, path):
        first = len(out) + 1
        root, depth = (above + [n])[0], len(above)
        seen[root, depth] = seen.get((root, depth), 0) + 1
        out[n] = None
        own = (depth, above, path + [place], root, first)
        number = seen[root, depth]
        for p, c in sorted(below.get(n, [])):
            walk(c, p, above + [n], path + [place])
        out[n] = (*own, len(out), number)

    for place, n in sorted(below.get(None, []), key=lambda x: x[1]):
        walk(n, place, [], [])
    return out


def test_index_of_odd_trees(spark):
    index = stored.stored(tree_index.built(frame(spark, NODES)), "t")
    want = plain(NODES)
    assert {r.id: (r.depth, r.ancestors, r.path, r.root, r.first, r.last, r.number) for r in index.collect()} == want and "x" not in want
    assert [tree_index.subtree(index, t).count() for t in ("a", "d", "x", "z", "?")] == [5, 1, 0, 0, 0]
    assert [[r.id for r in tree_index.next_after(index, t).collect()] for t in ("d", "b", "c", "e", "a", "?")] == [["c"], ["c"], ["e"], [], [], []]
    assert tree_index.below(index, "a", "d") and not tree_index.below(index, "b", "c") and not tree_index.below(index, "a", "x")
    assert sorted((r.head, r.number, r.id) for r in tree_index.page(index, 1, 1, 2).collect()) == [("b", 1, "b"), ("b", 1, "d"), ("c", 2, "c")]
    assert [r.id for r in tree_index.page(index, 1, 3, 9, root="a").collect()] == ["e"] and tree_index.page(index, 1, 9, 9, root="a").count() == 0
    assert tree_index.built(frame(spark, NODES[:0])).count() == 0


def test_index_of_a_random_tree_and_of_many_children(spark):
    r = random.Random(1)
    nodes = [("n0", None, 0)] + [(f"n{i}", f"n{r.choice([0, r.randrange(i)])}", r.randrange(5)) for i in range(1, 600)]
    index = tree_index.built(frame(spark, nodes)).collect()
    assert {x.id: (x.depth, x.ancestors, x.path, x.root, x.first, x.last, x.number) for x in index} == plain(nodes)


def test_a_deep_tree_takes_few_rounds(spark, monkeypatch):
    calls = []
    own = pointers.stored
    monkeypatch.setattr(pointers, "stored", lambda df, name: calls.append(name) or own(df, name))
    nodes = [("n0", None, 0)] + [(f"n{i}", f"n{i - 1}", 0) for i in range(1, 300)]
    found = pointers.lineage(frame(spark, nodes))
    assert found.agg(F.max("depth")).first()[0] == 299 and found.count() == 300
    assert len(calls) <= 1 + 9  # ceil(log2(300))


def test_subtree_is_a_range_of_the_stored_index(spark):
    plan = reading.h1_subtree(spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(first," in plan and "LessThanOrEqual(first," in plan and "Join" not in plan
    assert reading.indexed(spark, SF).inputFiles() == reading.indexed(spark, SF).inputFiles()  # built once


def follow(mapping, start, most=120):
    """last, hops, outcome as the operator defines them."""
    at, seen = start, []
    while True:
        seen.append(at)
        if len(seen) > most + 1:
            return None, None, "too_long"
        if at not in mapping:
            return (at, len(seen) - 1, "end")
        at = mapping[at]
        if at is None:
            return (None, len(seen), "removed") if len(seen) <= most else (None, None, "too_long")
        if at in seen:
            return (at, len(seen), "cycle") if len(seen) <= most else (None, None, "too_long")


@pytest.mark.parametrize("seed", [1, 2])
def test_chains(spark, seed):
    r = random.Random(seed)
    mapping = {i: r.choice([r.randrange(300), r.randrange(300), None]) for i in r.sample(range(300), 250)}
    mapping |= {1000 + i: 1001 + i for i in range(130)} | {2000 + i: 2001 + i for i in range(119)} | {3000 + i: 3000 + (i + 1) % 110 for i in range(110)} | {4000 + i: 4001 + i for i in range(30)} | {4030: 4020} | {5000: 5000}
    df = spark.createDataFrame(list(mapping.items()), "from_id long, to_id long").repartition(3)
    found = {x.start: (x.last, x.hops, x.outcome) for x in pointers.chains(df).collect()}
    assert found == {s: follow(mapping, s) for s in mapping}
    assert found[1000] == (None, None, "too_long") and found[2000] == (2119, 119, "end") and found[3000][2] == "cycle"


def test_120_hops_in_7_rounds(spark, monkeypatch):
    calls = []
    own = pointers.stored
    monkeypatch.setattr(pointers, "stored", lambda df, name: calls.append(name) or own(df, name))
    df = spark.createDataFrame([(i, i + 1) for i in range(120)], "from_id long, to_id long")
    assert pointers.chains(df).filter("start = 0").first().hops == 120
    assert calls == ["chains"] * 8  # the rows as they are, and 7 rounds


def test_routes(spark):
    articles = spark.createDataFrame([("now", True), ("old", False), ("older", False), ("gone", False), ("unclear", False), ("lone", False), ("c1", False), ("c2", False), ("lost", False), ("to unclear", False)], "id string, current boolean")
    pairs = [("old", "now", "unique"), ("older", "old", None), ("gone", None, "unique"), ("unclear", "now", "ambiguous"), ("c1", "c2", "unique"), ("c2", "c1", "unique"), ("lost", "nowhere", "unique"), ("to unclear", "unclear", "unique"), ("now", "old", "unique")]
    mapping = spark.createDataFrame(pairs, "from_id string, to_id string, status string")
    asked = spark.createDataFrame([(x,) for x in ("now", "old", "older", "gone", "unclear", "lone", "c1", "lost", "to unclear", "?")], "id string")
    found = {r.id: (r.outcome, r.target, r.reason) for r in pointers.routes(asked, articles, mapping).collect()}
    assert found == {
        "now": ("current", "now", None), "old": ("redirect", "now", None), "older": ("redirect", "now", None), "gone": ("removed", None, None), "unclear": ("historical", None, "ambiguous"),
        "lone": ("historical", None, "unmapped"), "c1": ("cycle", None, None), "lost": ("historical", None, "unmapped"), "to unclear": ("historical", None, "ambiguous"), "?": ("missing", None, None),
    }


def test_numbers_of_groups_over_many_parts(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", None, "a", "b"]), r.randrange(40), i) for i in range(3000)]
    found = ranking.numbered(spark.createDataFrame(rows, "g string, v int, id int").repartition(5), ["g"], ["v", "id"]).collect()
    want, counts = {}, {}
    for g, v, i in sorted(rows, key=lambda x: x[1:]):
        counts[g] = counts.get(g, 0) + 1
        want[i] = counts[g]
    assert {x.id: x.number for x in found} == want
