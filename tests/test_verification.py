"""Checks of candidates against plain rules: cycles of any length, collisions below missing parents, what a decision covers."""

from folio.operators import pointers, verification


def test_cycles_of_any_length(spark):
    nodes = [(f"t{i}", f"t{i + 1}" if i < 40 else None) for i in range(41)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "d"), ("self", "self"), ("lost", "nowhere"), ("below lost", "lost")]
    nodes += [(f"r{i}", f"r{(i + 1) % 70}") for i in range(70)]
    found = {r.id for r in pointers.on_cycles(spark.createDataFrame(nodes, "id string, parent string").repartition(3)).collect()}
    assert found == {"a", "b", "c", "d", "e", "self"} | {f"r{i}" for i in range(70)}
    assert pointers.on_cycles(spark.createDataFrame([], "id string, parent string")).count() == 0


def test_all_checks(spark):
    laws = spark.createDataFrame([("L", 9), ("M", 0), ("N", 4), ("E", 3), ("G", 2)], "law string, nodes_before long")
    nodes = [
        ("L", 1, None, "k1", "article", "1"), ("L", 2, None, "k1", "article", "1"), ("L", 3, 99, "k3", "item", "5"), ("L", 4, 98, "k4", "item", "5"), ("L", 5, 6, "k5", "column", None), ("L", 6, 5, "k6", "item", ""),
        ("M", 1, None, "m", "article", "1"), ("N", 1, None, "n1", "article", "1"), ("N", 2, 1, "n2", "paragraph", "1"), ("N", 3, 1, "n3", "item", "1"), ("N", 4, 2, "n4", "paragraph", "1"), ("G", 1, None, "g", "article", "1"),
    ]
    diff = [
        ("L", "a", "b", "renumbered"), ("L", "c", None, "ambiguous"), ("L", None, "d", "ambiguous"), ("L", "e", "f", "renumbered"), ("L", "x", None, "removed"),
        ("M", "a", "b", "renumbered"), ("M", "q", None, "ambiguous"), ("N", "p", "p", "modified"),
    ]
    mappings = [("L", "a", "b"), ("L", "c", "z"), ("L", "y", "d"), ("L", "e", "other"), ("M", "a", "b"), ("M", "a", "b"), ("M", "q", "r")]
    ranges = [("L", "r1", "blocked", "WHY"), ("L", "r2", "resolved", None)]
    frames = [
        spark.createDataFrame(nodes, "law string, index long, parent long, key string, level string, number string").repartition(2), spark.createDataFrame(diff, "law string, key_before string, key_after string, kind string"),
        spark.createDataFrame(ranges, "law string, range_id string, status string, reason string"), spark.createDataFrame(mappings, "law string, from_key string, to_key string"), spark.createDataFrame([("G", verification.GUARD), ("L", "other")], "law string, guard string"),
    ]
    found = verification.errors(laws, *frames)
    assert sorted((r.law, r.code, r.node or "") for r in found.collect()) == [
        ("E", "EMPTY_DOCUMENT", ""), ("E", "STRUCTURE_CHANGE_REVIEW_REQUIRED", ""), ("L", "COLLISION_SIBLING_NUMBER", "k1"), ("L", "COLLISION_SIBLING_NUMBER", "k4"), ("L", "CYCLE_DETECTED", "k5"), ("L", "CYCLE_DETECTED", "k6"),
        ("L", "DUPLICATE_DURABLE_KEY", "k1"), ("L", "ORPHAN_NODE", "k3"), ("L", "ORPHAN_NODE", "k4"), ("L", "RANGE_UNRESOLVED", "r1"), ("L", "STRUCTURE_CHANGE_REVIEW_REQUIRED", ""), ("L", "UNRESOLVED_DIFF", "e"),
    ]
    report = {r.law: (r.nodes, r.articles, r.changed, r.publishable) for r in verification.report(laws, frames[0], found).collect()}
    assert report == {"L": (6, 2, -0.3333, False), "M": (1, 1, 0.0, True), "N": (4, 1, 0.0, True), "E": (0, 0, -1.0, False), "G": (1, 1, -0.5, True)}
