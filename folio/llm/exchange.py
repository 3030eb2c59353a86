"""Counts of many hashes without a row for each: batches of texts exchange packed sorted hashes with buckets.

A batch of texts (a row of a written table, so it is the same for every reader) sends each of its
distinct hashes once, packed, to the hash's bucket, however often the batch has it; a hash that occurs
everywhere so reaches its bucket once for each batch. The bucket answers with a byte for each hash,
in the order sent. A batch's answers go back to it by a join on its number. With many buckets, batches and
buckets meet over stops (see Route), so the rows do not grow with the square of the input.

Hashes are cut to 32 bits within their bucket, and buckets grow with the number of partitions, so two
hashes are seldom taken for one; a count can then be too high, never too low, which users allow for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import STEP_BYTES, Texts, partitions, steps, written

_PRESS, _OPEN = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers, their bytes dealt into planes, compressed."""
    return _PRESS.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(_OPEN.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pressed(raw: bytes) -> bytes:
    return _PRESS.compress(raw)


def unpressed(raw: bytes) -> bytes:
    return _OPEN.decompress(raw)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as differences."""
    d = x.copy()
    d[1:] -= x[:-1]
    return pack(d)


def unpack_sorted(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


_BACK = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary())])
BACK = "batch long, bucket int, codes binary"
_BATCH = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary())])
BATCH = "batch long, ids array<long>, sizes array<long>, body binary"


def batched(docs: DataFrame, name: str, most: int = STEP_BYTES) -> DataFrame:
    """doc_id and text of docs as a written table with a row for about most bytes of text."""

    def f(batches: Iterator[pa.RecordBatch]):
        part, n = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(3)
        ids, sizes, bodies, held = [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip([[(part << 33) + n], [ids], [sizes], [press.compress(b"".join(bodies))]], _BATCH)], schema=_BATCH)

        for batch, texts in steps(batches, most=most):
            if held and held + len(texts.data) > most:
                yield close()
                ids, sizes, bodies, held, n = [], [], [], 0, n + 1
            ids += batch.column("doc_id").to_pylist()
            sizes += np.diff(texts.starts).tolist()
            bodies.append(texts.data.tobytes())
            held += len(texts.data)
        if ids:
            yield close()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, BATCH), name, "none")


def opened(batch: pa.RecordBatch, i: int) -> tuple[int, list, Texts]:
    """Number, document ids and texts of a row of such a table."""
    sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
    data = np.frombuffer(_OPEN.decompress(batch.column("body")[i].as_py()), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    return batch.column("batch")[i].as_py(), batch.column("ids")[i].as_py(), Texts(data, np.concatenate([[0], np.cumsum(sizes)]))


#: Bytes of text whose hashes one bucket, and so one task at a time, holds, about.
BUCKET_BYTES = 64 << 20
#: Buckets up to which batches send to them at once; beyond, by stops.
ONE_HOP = 512


class Route(NamedTuple):
    """How hashes get to their buckets.

    width: neighbouring buckets that share a stop; 1 where batches send to the buckets at once. groups: of batches; a stop merges what
    a group sends it. With about the square root of the buckets for width, stops and batches of a group, a batch sends a row to
    each stop, and what a group's batches have sent to a stop goes on as a row to each of its buckets: rows grow with the batches
    times twice that root, not with their square, and a stop's unit holds about as many hashes as one batch.
    """

    buckets: int
    width: int
    groups: int

    @property
    def stops(self) -> int:
        return -(-self.buckets // self.width)


def route_of(batches: DataFrame, each: int = BUCKET_BYTES, one_hop: int = ONE_HOP) -> Route:
    """A route for the hashes of such a table: buckets grow in number with its bytes, not in size; one for each partition at least."""
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    found = batches.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(partitions(batches.sparkSession), -(-(found.bytes or 0) // each))
    width = 1 if buckets <= one_hop else math.isqrt(buckets - 1) + 1
    return Route(buckets, width, -(-found.n // width) or 1)


def spots(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and key (lower half) of 64-bit hashes."""
    high = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return (high << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def code_of(counts: np.ndarray) -> np.ndarray:
    """A byte that rises with the count: 0 for one, 255 for 2**16 and more."""
    return np.minimum(255, np.floor(16 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


_SENT = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SENT = "batch long, bucket int, keys binary, counts binary"


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """rows dealt out by their column bucket, one bucket after the other in each task."""
    n = min(buckets, partitions(rows.sparkSession))
    return rows.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """One bucket after the other: its number and the columns of its rows."""
    bucket, held = None, {}
    for b in batches:
        numbers = b.column("bucket").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), b.num_rows]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            if bucket is not None and numbers[x] != bucket:
                yield bucket, held
                held = {}
            bucket = int(numbers[x])
            for name in b.schema.names:
                held.setdefault(name, []).extend(b.column(name).slice(x, y - x).to_pylist())
    if bucket is not None:
        yield bucket, held


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def relayed(first: DataFrame, route: Route, sent: tuple[pa.Schema, str], answered: Callable[[dict[str, list]], list[bytes]], merged: Callable, split: Callable) -> DataFrame:
    """batch, bucket (or stop) and codes: what comes back for each row of first (batch, bucket or stop, and the rest of sent).

    answered gives a reply for each row of a bucket. On the way over stops, merged(parts) makes of a unit's parts (dictionaries of the columns sent) rows
    (bucket, columns ...), and split(parts, replies in order of bucket) a reply for each part.
    """
    schema, text = sent

    def answer(rows):
        for bucket, own in buckets_of(rows):
            yield pa.RecordBatch.from_arrays([pa.array(own["batch"], pa.int64()), pa.array([bucket] * len(own["batch"]), pa.int32()), pa.array(answered(own), pa.binary())], schema=_BACK)

    if route.width == 1:
        return by_bucket(first, route.buckets).mapInArrow(answer, BACK)
    stops, names = route.stops, [f.name for f in schema][2:]

    def send(rows):
        for b in rows:
            for row in b.to_pylist():
                yield rows_of(schema, [(row["unit"], *r) for r in merged(row["parts"])])

    def back(rows):
        for b in rows:
            for row in b.to_pylist():
                replies = [r["codes"] for r in sorted(row["answers"] or [], key=lambda r: r["bucket"])]
                found = split(row["parts"], replies)
                yield rows_of(_BACK, [(p["batch"], row["unit"] % stops, c) for p, c in zip(row["parts"], found)])

    unit = F.pmod(F.xxhash64("batch"), F.lit(route.groups)) * stops + F.col("bucket")
    # named twice in the plan: Spark shuffles what batches send once for both
    units = first.groupBy(unit.alias("unit")).agg(F.collect_list(F.struct("batch", *names)).alias("parts"))
    replies = answers(by_bucket(units.mapInArrow(send, text), route.buckets).mapInArrow(answer, BACK))
    return units.join(replies.withColumnRenamed("batch", "unit"), "unit", "left").mapInArrow(back, BACK)


def _merged_keys(parts: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Keys of each part, the distinct ones of all, and for each of all the place among these."""
    keys = [unpack_sorted(p["keys"], np.uint64) for p in parts]
    return keys, *np.unique(np.concatenate(keys), return_inverse=True)


def _merge_counts(parts: list[dict]) -> list[tuple]:
    _, distinct, at = _merged_keys(parts)
    counts = np.bincount(at, np.concatenate([unpack(p["counts"], np.uint16) for p in parts]), len(distinct))
    return _by_bucket(distinct, np.minimum(counts, 65535).astype(np.uint16))


def _by_bucket(keys: np.ndarray, counts: np.ndarray, width: int = 1) -> list[tuple]:
    """(bucket or stop, keys, counts) of ascending spots; for stops of more than one bucket the keys are whole spots."""
    where = (keys >> np.uint64(32)).astype(np.int64) // width
    own = keys if width > 1 else keys.astype(np.uint32)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(keys)]]) if len(keys) else [0]
    return [(int(where[x]), pack_sorted(own[x:y]), pack(counts[x:y])) for x, y in zip(edges, edges[1:])]


def _split_codes(parts: list[dict], replies: list[bytes]) -> list[bytes]:
    keys, _, at = _merged_keys(parts)
    codes = np.concatenate([unpack(r, np.uint8) for r in replies])[at]
    return [pack(c) for c in np.split(codes, np.cumsum([len(k) for k in keys])[:-1])]


def _count(own: dict[str, list]) -> list[bytes]:
    keys = [unpack_sorted(k, np.uint32) for k in own["keys"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    codes = code_of(np.bincount(at, np.concatenate([unpack(c, np.uint16) for c in own["counts"]]), len(distinct)))[at]
    return [pack(c) for c in np.split(codes, np.cumsum([len(k) for k in keys])[:-1])]


def counted(batches: DataFrame, hashes: Callable[[Texts], np.ndarray], route: Route) -> DataFrame:
    """batches with the column answers, array<struct<bucket, codes>>: codes of the counts of spots of hashes(texts).

    Codes, in order of bucket, belong to np.unique(spots(hashes(texts), route.buckets)). hashes gives a value for each time that counts.
    """

    def send(rows):
        for b in rows:
            for i in range(b.num_rows):
                number, _, texts = opened(b, i)
                keys, counts = np.unique(spots(hashes(texts), route.buckets), return_counts=True)
                yield rows_of(_SENT, [(number, *r) for r in _by_bucket(keys, np.minimum(counts, 65535).astype(np.uint16), route.width)])

    back = relayed(batches.mapInArrow(send, SENT), route, (_SENT, SENT), _count, _merge_counts, _split_codes)
    return batches.join(answers(back), "batch", "left")


def answers(back: DataFrame) -> DataFrame:
    """batch and its answers, array<struct<bucket, codes>>: a row of a batch has one for each bucket or stop at most."""
    return back.groupBy("batch").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers"))


def codes_of(batch: pa.RecordBatch, i: int, kind=np.uint8) -> np.ndarray:
    """The codes of a row of counted(), in the order of np.unique of its spots; or other numbers that came back."""
    found = sorted(batch.column("answers")[i].as_py() or [], key=lambda a: a["bucket"])
    return np.concatenate([unpack(a["codes"], kind) for a in found] or [np.zeros(0, kind)])
