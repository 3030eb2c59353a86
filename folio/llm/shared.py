"""Shared folders, written tables and the vectorised view of texts that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a vectorised operator looks at; one longer text is a step of its own.
STEP_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one, in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-folio-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "snappy", tidy: bool = False) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage and survives lost executors.

    The folder belongs to the session; whoever owns spark.checkpoint.dir clears it. tidy: the write's shuffle files go when it is over, not with
    the driver's next garbage collection.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folio/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with facts, which has a row for each key and m, how many of the total rows have it.

    A key that a ten-thousandth of all rows have is broadcast, ten thousand rows at most, and its rows are not shuffled; other keys
    meet in a shuffle. rows and facts are read twice each, so both have to be written tables or cheap to derive from such. Keys aren't null.
    """
    most = total // 10_000 + 1
    hot = F.broadcast(facts.filter(F.col("m") >= most))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(facts.filter(F.col("m") < most).hint("merge"), keys))

class Texts(NamedTuple):
    """Texts of some rows laid end to end: bytes, and where each row's text starts (one more entry than rows)."""

    data: np.ndarray
    starts: np.ndarray


def _laid(column: pa.Array) -> Texts:
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with at most about most bytes of text each; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.null_count:
            column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
        whole = _laid(column)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(whole.starts, whole.starts[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            a, b = whole.starts[first], whole.starts[last]
            yield batch.slice(first, last - first), Texts(whole.data[a:b], whole.starts[first : last + 1] - a)
            first = last


# A polynomial hash over 64-bit words that wrap; the multiplier is odd, so it has an inverse.
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier, and of its inverse."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, STEP_BYTES + 4096)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:  # doubling
                step = np.uint64(pow(base, have, 1 << 64))
                take = min(have, size - have)
                out[have : have + take] = out[:take] * step
                have += take
            _powers.append(out)
        del _powers[:-2]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte * power before each place; differences of two give the hash of what lies between."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def hashes_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they lie."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are of [\\x20\\x09-\\x0D]."""
    return _SPACE[data]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


class Words(NamedTuple):
    """Words of some texts: row of each, where it lies in the bytes, its hash; first: of each row's first word, one more entry."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(texts: Texts, lower: bool = True) -> Words:
    """Runs of bytes other than [\\x20\\x09-\\x0D]; A-Z count as a-z if lower. A word ends with its text."""
    data, starts = texts
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(begin, starts)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    sums = prefix_sums(_LOWER[data] if lower else data)
    return Words(row, begin, end, hashes_between(sums, begin, end), first)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and hash of each run of k words of a text; a text with fewer words, but any, has one run of all."""
    n, rows = len(w.row), len(w.first) - 1
    counts = np.diff(w.first)
    at = np.flatnonzero(w.row[: max(0, n - k + 1)] == w.row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value = mixed(value + w.hash[at + j] * np.uint64(2 * j + 3))
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return w.row[at], at, value
    tail = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        more = counts[short] > j
        tail[more] = mixed(tail[more] + w.hash[w.first[short[more]] + j] * np.uint64(2 * j + 3))
    tail = mixed(tail + counts[short].astype(np.uint64))
    row, place, value = np.concatenate([w.row[at], short]), np.concatenate([at, w.first[short]]), np.concatenate([value, tail])
    order = np.argsort(row, kind="stable")
    assert rows >= 0
    return row[order], place[order], value[order]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch from numpy arrays, lists or Arrow arrays by name."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def byte_rows(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array whose values are data[edges[i]:edges[i+1]]."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def numbered(docs: DataFrame, *more: Column) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed to c0, c1, ... and more behind them, so that no helper column clashes; and the new name of each column."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    extra = [f"m{i}" for i in range(len(more))]
    out = docs.select("*", *more).toDF(*names, *extra)
    return out, dict(zip(docs.columns, names))


def renamed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns c0, c1, ... of df under the names they have in docs."""
    return df.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


class Memory:
    """Remembers what work gave for a key: about most keys at least, those used last; work treats many new keys at once."""

    def __init__(self, work: Callable[[list[bytes]], list[bytes]], most: int) -> None:
        self.work, self.most = work, most
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def of(self, keys: list[bytes]) -> list[bytes]:
        """What belongs to each of some distinct keys."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        out = [now.get(k) for k in keys]
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            x = before.get(keys[i])
            if x is None:
                new.append(i)
            else:
                out[i] = now[keys[i]] = x
        for i, x in zip(new, self.work([keys[i] for i in new]) if new else []):
            out[i] = now[keys[i]] = x
        return out


def coded(data: np.ndarray, edges: np.ndarray, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """The codes of data[edges[i]:edges[i+1]], end to end, and where each begins (one more entry); each distinct part is looked up once."""
    if len(edges) < 2:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = pa.py_buffer(np.ascontiguousarray(data))
    parts = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), raw]).dictionary_encode()
    found = pa.array(memory.of(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
    return _laid(found)
