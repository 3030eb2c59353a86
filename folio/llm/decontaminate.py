"""Benchmark decontamination with SimHash windows.

Each benchmark item has a weighted set of 5-word shingles (weight: how often it occurs) and a 64-bit
SimHash of them. Windows of a document with as many words as an item are fingerprinted in the same
way, at every word; a document with fewer words than the item is one window as a whole. Multi-index
Hamming search retrieves the items within RADIUS: fingerprints are cut into BLOCKS blocks, and two within
RADIUS differ by RADIUS // BLOCKS bits at most in one of them. An index of the items' blocks with up to one bit
changed meets a window's block with the other bits changed, so none within the radius is missed, while a fingerprint
at random meets an item in a few per cent of cases. The weighted Jaccard similarity of the shingles, sum of
minima over sum of maxima, then decides exactly.

Only windows that share a shingle with some item are fingerprinted: any other has similarity 0 with all
items. SimHash is a retrieval by chance: a passage at the threshold may lie outside the radius; recall
over all windows is measured in the tests.
Of neighbouring windows of one item, the best is reported, and of a passage in other text it is the one that fits.

The items are a stated query set: the driver reads them in parts of MAX_ITEM_WORDS words (16 bytes for each
word in a task), and each part is held against all documents.

Defined cases: words are runs of characters other than [\\x20\\x09-\\x0D], A-Z as a-z; a null or empty
text has no windows; an item with fewer than 5 words counts as one shingle and matches those words in
a row; an item without words matches nothing; repeated items and rows are each reported, a null id stays null; empty
tables give an empty result; further columns are left alone, whatever their names; a text longer than a step (STEP_BYTES) is a step of its own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import Texts, mixed, steps, words

K = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS = 4
MAX_ITEM_WORDS = 2_000_000
_BITS = np.arange(64, dtype=np.uint64)


def _changes(bits: int) -> np.ndarray:
    """All 16-bit numbers with up to so many bits."""
    return np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(16), n)], np.uint16)


def runs_of(w_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in place; the same values for the same words wherever they lie."""
    n = len(w_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for j in range(k):
        value = mixed(value + w_hash[j : j + n] * np.uint64(2 * j + 3))
    return value


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits."""
    return (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """64 sums of signs each to 64 bits; a sum of 0 counts as 0."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class Items:
    """The benchmark's items by shingle size and word count, with a multi-index over their fingerprints."""

    def __init__(self, ids: list, texts: list[str], radius: int = RADIUS, threshold: float = THRESHOLD) -> None:
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        w = words(Texts(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)))
        if radius > 31:
            raise ValueError("blocks don't select beyond a radius of 31 bits")
        self.radius, self.threshold = radius, threshold
        self.ids, self.words, self.bags, self.k = [], [], [], []
        for i, name in enumerate(ids):
            own = w.hash[w.first[i] : w.first[i + 1]]
            if not len(own):
                continue
            k = min(K, len(own))
            values, counts = np.unique(runs_of(own, k), return_counts=True)
            self.ids.append(name)
            self.words.append(len(own))
            self.k.append(k)
            self.bags.append((values, counts))
        self.words, self.k = np.array(self.words, np.int64), np.array(self.k, np.int64)
        self.prints = np.array([fingerprint((signs(v) * c[:, None]).sum(axis=0)[None, :])[0] for v, c in self.bags], np.uint64)
        # shingle -> items that have it, in a flat sorted form
        pairs = sorted((int(v), i) for i, (vs, _) in enumerate(self.bags) for v in vs)
        self.shingles = {}
        for k in sorted(set(self.k.tolist())):
            own = [p for p in pairs if self.k[p[1]] == k]
            self.shingles[k] = (np.array([p[0] for p in own], np.uint64), np.array([p[1] for p in own], np.int64))
        self._of_size: dict[int, list] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_of_size": {}}  # made by each task, as sizes come up

    def _blocks(self, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of the items of size words: which values are within reach of one, and the values with up to one bit changed, sorted, with their items."""
        if size not in self._of_size:
            own, out = np.flatnonzero(self.words == size), []
            values = self.prints[own].view(np.uint16).reshape(-1, BLOCKS)
            far, near = _changes(self.radius // BLOCKS), _changes(min(1, self.radius // BLOCKS))
            for b in range(BLOCKS):
                reach = np.zeros(1 << 16, bool)
                reach[(values[:, b, None] ^ far).reshape(-1)] = True
                keys = (values[:, b, None] ^ near).reshape(-1)
                order = np.argsort(keys, kind="stable")
                out.append((reach, keys[order], np.repeat(own, len(near))[order]))
            self._of_size[size] = out
        return self._of_size[size]

    def near(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item of size words) whose fingerprints are within the radius, each once."""
        found = [np.zeros((0, 2), np.int64)]
        values = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, BLOCKS)
        rest = _changes(max(0, self.radius // BLOCKS - 1))
        for b, (reach, keys, items) in enumerate(self._blocks(size)):
            some = np.flatnonzero(reach[values[:, b]])
            asked = values[some, b, None] ^ rest
            first, last = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            window, _ = np.nonzero(last > first)
            at, n = first[last > first], (last - first)[last > first]
            steps_ = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([np.repeat(some[window], n), items[np.repeat(at, n) + steps_]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        close = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= self.radius
        return pairs[close, 0], pairs[close, 1]


def matches(w_hash: np.ndarray, items: Items) -> list[tuple[int, int, float]]:
    """(item, first word, similarity) of the best window for each place and item in one document's words."""
    out = []
    for k, (keys, owners) in items.shingles.items():
        runs = runs_of(w_hash, k)
        if not len(runs):
            continue
        at = np.searchsorted(keys, runs)
        hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == runs)
        if not len(hit):
            continue
        # sizes of the items that share a shingle; windows of that size that hold the shared run
        last = np.searchsorted(keys, runs[hit], "right")
        spread = np.repeat(hit, last - at[hit])
        item = owners[np.concatenate([np.arange(a, b) for a, b in zip(at[hit], last)])]
        for size in np.unique(items.words[item]):
            span = int(size) - k + 1
            if len(runs) < span:  # a document shorter than the item is one window, unless too short to reach the threshold
                if len(runs) / span < items.threshold:
                    continue
                span = len(runs)
            places = np.unique(spread[items.words[item] == size])
            low, high = np.maximum(0, places - span + 1), np.minimum(len(runs) - span, places)
            flag = np.zeros(len(runs) + 1, np.int64)
            ok = high >= low
            np.add.at(flag, low[ok], 1)
            np.add.at(flag, high[ok] + 1, -1)
            starts = np.flatnonzero(np.cumsum(flag[:-1]) > 0)
            if not len(starts):
                continue
            found = []
            for a in range(0, len(starts), 4096):  # neighbours share sums
                own = starts[a : a + 4096]
                lo, hi = own[0], own[-1] + span
                if hi - lo > 64 * len(own) + span:
                    sums = np.stack([signs(runs[s : s + span]).sum(axis=0) for s in own])
                else:
                    total = np.zeros((hi - lo + 1, 64), np.int32)
                    np.cumsum(signs(runs[lo:hi]), axis=0, out=total[1:])
                    sums = total[own - lo + span] - total[own - lo]
                window, near = items.near(int(size), fingerprint(sums))
                for x, i in zip(window.tolist(), near.tolist()):
                    s = similarity(runs[own[x] : own[x] + span], items.bags[i])
                    if s >= items.threshold:
                        found.append((i, int(own[x]), s))
            out += best(found, int(size))
    return out


def similarity(run: np.ndarray, bag: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of a window's shingles and an item's."""
    values, counts = np.unique(run, return_counts=True)
    at = np.searchsorted(bag[0], values)
    at[at == len(bag[0])] = 0
    same = bag[0][at] == values
    both = int(np.minimum(counts[same], bag[1][at[same]]).sum())
    return both / (int(counts.sum()) + int(bag[1].sum()) - both)


def best(found: list[tuple[int, int, float]], size: int) -> list[tuple[int, int, float]]:
    """Of an item's overlapping windows the most similar, then the first."""
    out, taken = [], defaultdict(list)
    for i, start, s in sorted(found, key=lambda x: (-x[2], x[1])):
        own = taken[i]
        at = bisect_left(own, start)
        if (at and start - own[at - 1] < size) or (at < len(own) and own[at] - start < size):
            continue
        insort(own, start)
        out.append((i, start, s))
    return out


_SCHEMA = "doc_id long, item_id long, start_word int, n_words int, start_byte long, end_byte long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, place (words, bytes) and similarity of each passage of an item in docs."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ids, texts in _parts(benchmark):
        items = Items(ids, texts, radius, threshold)
        part = chosen.mapInArrow(_finder(items), _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return chosen.sparkSession.createDataFrame([], _SCHEMA) if out is None else out


def _parts(benchmark: DataFrame, most: int = MAX_ITEM_WORDS) -> Iterator[tuple[list, list]]:
    """The items in parts of most words at most, or of one item."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row[1] or "").split())
        if ids and size + n > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1] or "")
        size += n
    if ids:
        yield ids, texts


def _finder(items: Items):
    def f(batches):
        for batch, texts in steps(batches):
            w = words(texts)
            maybe = np.zeros(len(w.first) - 1, bool)
            for k, (keys, _) in items.shingles.items():  # a first look at all runs of the step at once
                runs = runs_of(w.hash, k)
                if len(runs):
                    at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
                    maybe[w.row[np.flatnonzero(keys[at] == runs)]] = True
            rows = []
            for r in np.flatnonzero(maybe).tolist():
                a, b = int(w.first[r]), int(w.first[r + 1])
                doc, base = batch.column("doc_id")[r].as_py(), texts.starts[r]
                for i, start, s in matches(w.hash[a:b], items):
                    n = min(int(items.words[i]), b - a - start)
                    rows.append((doc, items.ids[i], start, n, int(w.start[a + start] - base), int(w.end[a + start + n - 1] - base), s))
            if rows:
                names = ["doc_id", "item_id", "start_word", "n_words", "start_byte", "end_byte", "similarity"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return f


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without any passage of the benchmark, all columns; decided where the rows lie, without a shuffle."""
    out = docs
    for ids, texts in _parts(benchmark):
        items = Items(ids, texts, radius, threshold)

        def f(batches, items=items):
            find = _finder_rows(items)
            for batch, texts in steps(batches):
                keep = ~find(texts)
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(f, out.schema)
    return out


def _finder_rows(items: Items):
    def find(texts: Texts) -> np.ndarray:
        w = words(texts)
        maybe = np.zeros(len(w.first) - 1, bool)
        for k, (keys, _) in items.shingles.items():
            runs = runs_of(w.hash, k)
            if len(runs):
                at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
                maybe[w.row[np.flatnonzero(keys[at] == runs)]] = True
        for r in np.flatnonzero(maybe).tolist():
            maybe[r] = bool(matches(w.hash[w.first[r] : w.first[r + 1]], items))
        return maybe

    return find
