"""Removal of byte strings that also start in an earlier document, without sorting every suffix.

The named method, a difference-cover suffix sort, moves a key and a place of 16 bytes for two thirds of
all bytes on each level, several times what the disk limit allows (figures in the README). Only strings
of SPAN bytes matter here, so suffixes are sampled by content instead of by position: of each
SPAN - GRAM + 1 neighbouring GRAM-byte strings the one with the smallest hash is an anchor. Equal strings of
SPAN bytes hold equal anchors at equal places, so whatever repeats meets at an anchor, and about a fourteenth
of all places is looked at. (1) Anchors are counted over all documents (see exchange); others take no
further part. (2) Anchors that occur more than once are sent, with the bytes around them, to their
bucket; there the strings around equal anchors are brought together for every offset, and each
string's smallest document is found. Hashes only bring strings together: their bytes are compared, and strings
of one hash that differ are told apart. (3) The answers are laid over the texts.

Defined cases: null and empty texts have no bytes; a null doc_id counts as larger than any other;
rows with the same doc_id do not count as earlier than each other; an empty table gives an empty
result; further columns are left alone, whatever their names. A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.exchange import Route, answers, batched, codes_of, counted, opened, pack, pack_sorted, pressed, relayed, route_of, rows_of, spots, unpack, unpack_sorted, unpressed
from folio.llm.shared import STEP_BYTES, Texts, hashes_between, mixed, powers, prefix_sums, written

SPAN = 50
GRAM = 24
SIDE = SPAN - GRAM
WIDTH = SIDE + GRAM + SIDE
#: Entries of a bucket that are compared at a time, about; a group of equal anchors is never parted.
STEP_ENTRIES = 1 << 15
_LAST = (1 << 63) - 1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slid(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for each i; what lies beyond the end is left out."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        have += step
    return out


#: Bytes that are looked at together in the search for anchors; what is worked out for them fits a processor's cache.
PIECE = 1 << 15


def anchors(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in the bytes, and the hashes of their GRAM bytes."""
    data, starts = texts
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(starts)
    long = np.flatnonzero(sizes >= SPAN)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - SPAN + 1, -1)
    bad = np.cumsum(inside[:-1]) == 0  # strings of SPAN bytes that do not lie in one text
    found = []
    for first in range(0, n, PIECE):
        a, b = max(0, first - SIDE), min(n, first + PIECE + SPAN)  # a place is judged by what is this near
        places, gram = _anchors(data[a:b], bad[a:b])
        own = (places + a >= first) & (places + a < first + PIECE)
        found.append((places[own] + a, gram[own]))
    return np.concatenate([p for p, _ in found]), np.concatenate([g for _, g in found])


def _anchors(data: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    _, down = powers(n)
    gram = np.full(n, _TOP, np.uint64)
    gram[: n - GRAM + 1] = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1] + np.uint64(GRAM))
    least = _slid(gram, SIDE + 1, np.minimum)  # of the strings that start in [i, i + SIDE]
    least[bad] = 0
    # an anchor is the least of some string that holds it: the largest of those leasts
    back = _slid(least[::-1], SIDE + 1, np.maximum)[::-1]
    places = np.flatnonzero((back == gram) & (gram != _TOP))
    return places, mixed(gram[places])  # the smallest hashes, spread over all buckets again


_KEPT = pa.schema([("batch", pa.int64()), ("places", pa.binary()), ("held", pa.int64()), ("free_ids", pa.list_(pa.int64())), ("free_sizes", pa.list_(pa.int64())), ("free_sha", pa.list_(pa.string()))])


def _repeated(batches: DataFrame, route: Route) -> DataFrame:
    """Places of the anchors of each batch that occur elsewhere, and how many texts have one; other texts are done: id, size and SHA-256."""

    def f(rows):
        for b in rows:
            for i in range(b.num_rows):
                number, ids, texts = opened(b, i)
                places, gram = anchors(texts)
                where = spots(gram, route.buckets)
                if len(gram):
                    places = places[codes_of(b, i)[np.searchsorted(np.unique(where), where)] > 0]
                hit = np.zeros(len(ids), bool)
                hit[np.searchsorted(texts.starts, places, "right") - 1] = True
                free = np.flatnonzero(~hit)
                sha = [hashlib.sha256(texts.data[texts.starts[j] : texts.starts[j + 1]]).hexdigest() for j in free]
                values = [[number], [pack_sorted(places.astype(np.uint64))], [int(hit.sum())], [[ids[j] for j in free]], [np.diff(texts.starts)[free].tolist()], [sha]]
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(values, _KEPT)], schema=_KEPT)

    found = counted(batches, lambda t: anchors(t)[1], route)
    return written(found.mapInArrow(f, "batch long, places binary, held long, free_ids array<long>, free_sizes array<long>, free_sha array<string>"), "repeat-places", "zstd", tidy=True)


class Around(NamedTuple):
    """Anchors of a batch and what lies around them; entries: the distinct ones, as they are sent."""

    places: np.ndarray
    doc: np.ndarray
    valid: np.ndarray  # bit o: the string of SPAN bytes that starts o bytes before the anchor lies in the text
    entry: np.ndarray  # number of each anchor's entry
    gram: np.ndarray  # of each entry, ascending by bucket
    first: np.ndarray  # an anchor of each entry, of its smallest document
    bucket: np.ndarray
    around: np.ndarray  # of each entry, SIDE bytes before, the anchor and SIDE bytes behind; 0 beyond the text


def _around(b: pa.RecordBatch, i: int, buckets: int) -> tuple[list, Texts, Around]:
    _, ids, texts = opened(b, i)
    places = unpack_sorted(b.column("places")[i].as_py(), np.uint64).astype(np.int64)
    row = np.searchsorted(texts.starts, places, "right") - 1
    doc = np.array([_LAST if x is None else x for x in ids], np.int64)[row]
    left = np.minimum(SIDE, places - texts.starts[row])
    right = np.minimum(SIDE, texts.starts[row + 1] - places - GRAM)
    one = np.int64(1)
    valid = (((one << (left + 1)) - 1) & ~((one << (SIDE - right)) - 1)).astype(np.uint32)  # offsets from SIDE - right to left
    sums = prefix_sums(texts.data)
    gram = mixed(hashes_between(sums, places, places + GRAM))
    whole = mixed(hashes_between(sums, places - left, places + GRAM + right) + (left * 64 + right).astype(np.uint64))
    bucket = (spots(gram, buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((doc, whole, gram))  # buckets ascend with the hash
    new = np.ones(len(order), bool)
    g, w, lines = gram[order], whole[order], _lines(texts, places, left, right)[order]
    new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (lines[1:] != lines[:-1]).any(axis=1)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    first = order[new]
    return ids, texts, Around(places, doc, valid, entry, gram[first], first, bucket[first], lines[new])


def _lines(texts: Texts, places: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """WIDTH bytes around each anchor; those more than left before it or right behind it, in other texts, are 0."""
    padded = np.concatenate([np.zeros(SIDE, np.uint8), texts.data, np.zeros(SIDE, np.uint8)])
    if not len(places):
        return np.zeros((0, WIDTH), np.uint8)
    out = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[places]
    some = np.flatnonzero((left < SIDE) | (right < SIDE))
    at = np.arange(WIDTH)
    cut = out[some]
    cut[(at < SIDE - left[some, None]) | (at >= SIDE + GRAM + right[some, None])] = 0
    out[some] = cut
    return out


_SENT = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("lines", pa.binary()), ("valid", pa.binary()), ("docs", pa.binary()), ("buckets", pa.binary())])
SENT = "batch long, bucket int, lines binary, valid binary, docs binary, buckets binary"


def _hashes(strings: np.ndarray) -> np.ndarray:
    """Hashes of byte strings of one length, the rows of a table."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    out = np.zeros(n, np.uint64)
    for word in padded.view(np.uint64).T:
        out = (out + mixed(word + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(out)


def _grams(lines: np.ndarray) -> np.ndarray:
    """Hashes of the anchors of such lines."""
    return _hashes(lines[:, SIDE : SIDE + GRAM])


def _masks(gram: np.ndarray, lines: np.ndarray, valid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the offsets (as bits) whose string of SPAN bytes starts in a document with a smaller id.

    Entries with the same bytes around them, as copies have, are one line with its smallest document: the others
    have each of their strings there. Only different lines around equal anchors are compared further.
    """
    out = np.zeros(len(gram), np.uint32)
    if not len(gram):
        return out
    order = np.lexsort((_hashes(lines), gram))
    new = np.ones(len(order), bool)
    g, v, sorted_lines = gram[order], valid[order], lines[order]
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1]) | (sorted_lines[1:] != sorted_lines[:-1]).any(axis=1)
    edges = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], edges)
    found = _masks_of_lines(g[edges], sorted_lines[edges], v[edges], least)
    line = np.cumsum(new) - 1
    out[order] = np.where(doc[order] > least[line], v, found[line])
    return out


def _masks_of_lines(gram: np.ndarray, lines: np.ndarray, valid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(gram), np.uint32)
    order = np.argsort(gram, kind="stable")
    edges = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
    low, high = np.minimum.reduceat(doc[order], edges), np.maximum.reduceat(doc[order], edges)
    several = np.empty(len(gram), bool)
    several[order] = np.repeat(low != high, np.diff(np.append(edges, len(order))))
    order = order[several[order]]
    # groups of equal anchors, some thousand entries at a time
    edges = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1])) if len(order) else order
    first = 0
    while first < len(order):
        k = np.searchsorted(edges, first + STEP_ENTRIES)
        last = edges[k] if k < len(edges) else len(order)
        own = order[first:last]
        out[own] = _open_masks(gram[own], lines[own], valid[own], doc[own])
        first = last
    return out


def _open_masks(gram: np.ndarray, lines: np.ndarray, valid: np.ndarray, doc: np.ndarray, mix=mixed) -> np.ndarray:
    out = np.zeros(len(gram), np.uint32)
    sums = [np.zeros((len(gram), SIDE + 1), np.uint64), np.zeros((len(gram), SIDE + 1), np.uint64)]  # of the nearest bytes on each side
    for j in range(SIDE):
        factor = np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        for at, total in zip((SIDE - 1 - j, SIDE + GRAM + j), sums):
            total[:, j + 1] = total[:, j] + (lines[:, at].astype(np.uint64) + np.uint64(1)) * factor
    for o in range(SIDE + 1):
        some = np.flatnonzero((valid >> np.uint32(o)) & np.uint32(1))
        if not len(some):
            continue
        key = mix(mix(gram[some] + mix(sums[0][some, o])) + sums[1][some, SIDE - o])
        own = lines[some, SIDE - o : SIDE - o + SPAN]
        order = np.argsort(key)
        if _clash(key[order], own[order]):  # two strings with one hash: their bytes are the key
            key = np.unique(np.ascontiguousarray(own).view(f"S{SPAN}").reshape(-1), return_inverse=True)[1]
            order = np.argsort(key)
        edges = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        least = np.repeat(np.minimum.reduceat(doc[some[order]], edges), np.diff(np.append(edges, len(order))))
        hit = some[order][least < doc[some[order]]]
        out[hit] |= np.uint32(1 << o)
    return out


def _clash(key: np.ndarray, strings: np.ndarray) -> bool:
    """Whether two neighbours with equal keys have different bytes."""
    same = np.flatnonzero(key[1:] == key[:-1])
    return bool((strings[same] != strings[same + 1]).any())


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def _opened_lines(parts: list[bytes], valid: list[bytes], docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, valid and docs of several rows, end to end, and where each but the first begins."""
    raw = [unpressed(x) for x in parts]
    lines = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH)
    return lines, np.concatenate([unpack(x, np.uint32) for x in valid]), np.concatenate([unpack(x, np.int64) for x in docs]), np.cumsum([len(x) // WIDTH for x in raw])[:-1]


def _lines_by_bucket(lines: np.ndarray, valid: np.ndarray, doc: np.ndarray, bucket: np.ndarray, width: int = 1) -> list[tuple]:
    """(bucket or stop, lines, valid, docs, buckets) of entries that ascend by bucket."""
    where = bucket // width
    edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]) if len(where) else [0]
    return [(int(where[x]), pressed(lines[x:y].tobytes()), pack(valid[x:y]), pack(doc[x:y]), pack_sorted(bucket[x:y].astype(np.uint32)) if width > 1 else b"") for x, y in zip(edges, edges[1:])]


def _buckets(parts: list[dict]) -> np.ndarray:
    return np.concatenate([unpack_sorted(p["buckets"], np.uint32) for p in parts]).astype(np.int64)


def _merge_lines(parts: list[dict]) -> list[tuple]:
    lines, valid, doc, _ = _opened_lines(*([p[k] for p in parts] for k in ("lines", "valid", "docs")))
    bucket = _buckets(parts)
    order = np.argsort(bucket, kind="stable")
    return _lines_by_bucket(lines[order], valid[order], doc[order], bucket[order])


def _split_masks(parts: list[dict], replies: list[bytes]) -> list[bytes]:
    order = np.argsort(_buckets(parts), kind="stable")
    masks = np.empty(len(order), np.uint32)
    masks[order] = np.concatenate([unpack(r, np.uint32) for r in replies])
    return [pack(m) for m in np.split(masks, np.cumsum([len(unpack(p["docs"], np.int64)) for p in parts])[:-1])]


def _answered(own: dict[str, list]) -> list[bytes]:
    lines, valid, doc, edges = _opened_lines(own["lines"], own["valid"], own["docs"])
    return [pack(m) for m in np.split(_masks(_grams(lines), lines, valid, doc), edges)]


def removed_repeats(docs: DataFrame, *, batch_bytes: int = STEP_BYTES, **route) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed bytes, from start to before end) of each document."""
    batches = batched(docs, "repeat-batches", batch_bytes)
    route = route_of(batches, **route)
    places = _repeated(batches, route)

    def send(rows):
        for b in rows:
            for i in range(b.num_rows):
                _, _, a = _around(b, i, route.buckets)
                own = _lines_by_bucket(a.around, a.valid[a.first], a.doc[a.first], a.bucket, route.width)
                yield rows_of(_SENT, [(b.column("batch")[i].as_py(), *r) for r in own])

    def laid(rows):
        for b in rows:
            for i in range(b.num_rows):
                ids, texts, a = _around(b, i, route.buckets)
                masks = codes_of(b, i, np.uint32)
                own = np.where(a.doc > a.doc[a.first][a.entry], a.valid, masks[a.entry] & a.valid) if len(a.places) else masks
                change = np.zeros(len(texts.data) + 1, np.int32)
                for o in range(SIDE + 1):
                    start = a.places[(own >> np.uint32(o)) & np.uint32(1) > 0] - o
                    np.add.at(change, start, 1)
                    np.add.at(change, start + SPAN, -1)
                covered = np.cumsum(change[:-1]) > 0
                columns: list[list] = [[] for _ in range(6)]
                hit = np.zeros(len(ids), bool)  # the other texts are done
                hit[np.searchsorted(texts.starts, a.places, "right") - 1] = True
                for j in np.flatnonzero(hit):
                    doc, s, e = ids[j], texts.starts[j], texts.starts[j + 1]
                    gone = covered[s:e]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept = texts.data[s:e][~gone]
                    values = [doc, int(e - s), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]]
                    for c, v in zip(columns, values):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    # named twice in the plan: Spark shuffles the batches once for both
    held = batches.join(places.filter("held > 0").select("batch", "places"), "batch")
    back = answers(relayed(held.mapInArrow(send, SENT), route, (_SENT, SENT), _answered, _merge_lines, _split_masks))
    found = held.join(back, "batch", "left").mapInArrow(laid, _OUT)
    free = places.select(F.explode(F.arrays_zip("free_ids", "free_sizes", "free_sha")).alias("x"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    free = free.select(F.col("x.free_ids").alias("doc_id"), F.col("x.free_sizes").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("x.free_sha").alias("kept_sha256"), none.alias("spans"))
    return found.unionByName(free)
