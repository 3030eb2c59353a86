"""Hashes that meet their buckets over stops give what they give at once, and rows that grow with the batches, not their square."""

import sys
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("folio.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from folio.llm import exchange, jaccard_join, repeats  # noqa: E402
from folio.llm.shared import words  # noqa: E402
from test_llm import corpus, frame, got  # noqa: E402

STOPS = {"batch_bytes": 700, "each": 600, "one_hop": 2}


def texts_of(n, seed=0):
    r = np.random.default_rng(seed)
    return [(i, " ".join(f"w{x}" for x in r.zipf(1.3, 40) % 500)) for i in range(n)]


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_over_stops(spark, seed):
    rows = corpus(seed)
    assert got(repeats.removed_repeats(frame(spark, rows), **STOPS), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_components_over_stops(spark, seed):
    rows = corpus(seed)
    assert got(jaccard_join.joined(frame(spark, rows), count_links=False, **STOPS), "doc_id", "n_shingles", "component_id") == brute.components(rows)


def test_counts_over_stops_are_those_at_once(spark):
    batches = exchange.batched(frame(spark, texts_of(300)), "test", 800)
    own = exchange.route_of(batches, 1 << 9, one_hop=10**9)
    route = exchange.route_of(batches, 1 << 9, one_hop=1)
    assert own.width == 1 and route.width > 3 and own.buckets == route.buckets
    a, b = ({r.batch: [x["codes"] for x in sorted(r.answers, key=lambda x: x["bucket"])] for r in exchange.counted(batches, lambda t: words(t).hash, x).collect()} for x in (own, route))
    codes = [{k: np.concatenate([exchange.unpack(bytes(c), np.uint8) for c in v]).tolist() for k, v in x.items()} for x in (a, b)]
    assert codes[0] == codes[1] and max(map(max, codes[0].values())) > 50


def test_rows_grow_with_the_batches(spark):
    """Ten times the batches: rows by batch grow with the root of the buckets, and a unit's hashes don't grow."""
    for n in (60, 600):
        batches = exchange.batched(frame(spark, texts_of(n)), "test", 800)
        route, count = exchange.route_of(batches, 1 << 9, one_hop=1), batches.count()
        sent = []

        def spy(first, route_, *rest):
            sent.append((first.count(), route_))
            return own_relayed(first, route_, *rest)

        own_relayed, exchange.relayed = exchange.relayed, spy
        try:
            exchange.counted(batches, lambda t: words(t).hash, route).count()
        finally:
            exchange.relayed = own_relayed
        rows, root = sent[0][0], route.buckets**0.5
        onward = route.groups * route.stops * route.width  # a row for each unit and bucket of its stop at most
        assert rows <= count * route.stops and rows + onward <= 2.5 * count * (root + 1)
        assert count / route.groups <= root + 1  # batches that meet in a unit, each with its share of one of as many stops
    assert route.buckets > 100
