"""Suffix order of all texts by a distributed difference cover, and the removal of repeated strings read off it.

Every suffix is a row (sid, i, ...): the string it belongs to and where it starts. (1) The suffixes that start at
places 1 and 2 modulo 3 are sampled; their first three symbols are sorted and named by their rank. (2) The names
of a string's two kinds of places form two shorter strings, which are ordered in the same way; names stand for
3, 9, 27, ... bytes, and the recursion ends where three of them span the bytes that are asked for. (3) The
remaining suffixes are merged in: with one at place 1 each compares by a symbol and the rank behind it, with one at
place 2 by two symbols and the rank behind them, so two sorts with running counts give every rank. (4) Neighbours
in the order whose first bytes are equal form a group; a group's smallest document keeps its string.

Sorts are Spark's, by range of key and place, so equal keys of any number are spread; the driver sees a row for
each partition (its first and last key and its counts), nothing else. No task holds a group: groups are numbered as
the sorted rows pass, and their smallest document is an aggregate. Ranks order the first span bytes at least; equal ranks have them equal.

removed_repeats() has the columns and defined cases of folio.llm.repeats, which the registered query uses: this form moves
rows of 16 bytes and more for every byte of text some ten times (figures in the README).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.repeats import SPAN
from folio.llm.shared import partitions, steps, written

#: Places of a string that are looked at together where neighbouring symbols are brought into one row.
BLOCK = 1 << 16
_LAST = (1 << 63) - 1


def _beside(t: DataFrame, **further: tuple[str, int]) -> DataFrame:
    """t, rows (sid, i, s and, of some, r), one for each place, with the s or r that stands some places further; 0 beyond the end.

    Rows of one place are made one. Long strings are cut into blocks; the first two rows of a block are also in the one before.
    """
    block = F.floor(F.col("i") / BLOCK)
    also = F.when((F.col("i") % BLOCK < 2) & (F.col("i") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    values = [c for c in t.columns if c not in ("sid", "i")]
    rows = t.withColumn("block", F.explode(also)).repartition(partitions(t.sparkSession), "sid", "block")
    rows = rows.groupBy("sid", "block", "i").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in values])
    w = Window.partitionBy("sid", "block").orderBy("i")
    rows = rows.select("*", *[F.lead(c, k, 0).over(w).alias(name) for name, (c, k) in further.items()])
    return rows.filter(F.col("block") == block).drop("block")


def _less(rows: DataFrame, keys: list[str], ones: list[str], name: str) -> DataFrame:
    """rows with each of the 0/1 columns ones replaced by how many of it stand at strictly smaller keys, anywhere."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(partitions(spark), *keys, "sid", "i").sortWithinPartitions(*keys)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + ["part int", "opening boolean"] + [f"below_{c} long" for c in ones])

    def f(batches):
        part, groups, last = TaskContext.get().partitionId(), 0, None
        total, below = np.zeros((len(ones), 1), np.int64), np.zeros((len(ones), 1), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in keys])
            one = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ones])
            new = np.ones(n, bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            new[0] = last is None or bool((key[:, 0] != last).any())
            before = total + np.cumsum(one, axis=1) - one
            group = np.cumsum(new)
            found = np.concatenate([below, before[:, new]], axis=1)[:, group]
            opening = groups + group == 1
            total, below, last, groups = total + one.sum(axis=1, keepdims=True), found[:, -1:], key[:, -1], groups + int(group[-1])
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(np.full(n, part, np.int32)), pa.array(opening), *[pa.array(x) for x in found]], names=b.schema.names + ["part", "opening"] + [f"below_{c}" for c in ones])

    table = written(ordered.mapInArrow(f, schema), name, "zstd")
    sums = [F.sum(c).alias(c) for c in ones] + [F.max(f"below_{c}").alias(f"below_{c}") for c in ones]
    parts = table.groupBy("part").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys)).alias("last"), *sums).orderBy("part").collect()
    bases, total, tail, last = [], [0] * len(ones), [0] * len(ones), None
    for p in parts:  # a row for each partition
        same = last is not None and p["first"] == last
        bases.append((p["part"], *total, *[t - x * same for t, x in zip(total, tail)]))
        own = [p[c] - p[f"below_{c}"] for c in ones]  # those at the partition's last key
        tail = [a + b for a, b in zip(own, tail)] if same and p["first"] == p["last"] else own
        total = [t + p[c] for t, c in zip(total, ones)]
        last = p["last"]
    kinds = ", ".join(["part int"] + [f"{x}_{c} long" for x in ("base", "start") for c in ones])
    base = F.broadcast(spark.createDataFrame(bases, kinds))  # a row for each partition
    counts = {c: F.col(f"below_{c}") + F.when(F.col("opening"), F.col(f"start_{c}")).otherwise(F.col(f"base_{c}")) for c in ones}
    return table.join(base, "part").select(*[counts[c].alias(c) if c in ones else c for c in rows.columns])


def _ranks(t: DataFrame, width: int, span: int) -> DataFrame:
    """sid, i and r, from 1, of every suffix of the strings t (sid, i, s > 0), whose symbols stand for width bytes each."""
    triples = _beside(t, s1=("s", 1), s2=("s", 2)).withColumn("one", F.lit(1).cast("long"))
    if 3 * width >= span:
        return _less(triples, ["s", "s1", "s2"], ["one"], "suffix-triples").select("sid", "i", (F.col("one") + 1).alias("r"))
    triples = triples.filter("i % 3 > 0")
    if width == 1:  # three bytes are a number in the order of their triples
        names = triples.select("sid", "i", (F.col("s") * 257 * 257 + F.col("s1") * 257 + F.col("s2")).alias("s"))
    else:
        names = _less(triples, ["s", "s1", "s2"], ["one"], "suffix-triples").select("sid", "i", (F.col("one") + 1).alias("s"))
    shorter = names.select((F.col("sid") * 2 + F.col("i") % 3 - 1).alias("sid"), F.floor(F.col("i") / 3).alias("i"), "s")
    below = _ranks(shorter, 3 * width, span)
    sample = below.select(F.floor(F.col("sid") / 2).alias("sid"), (F.col("i") * 3 + F.col("sid") % 2 + 1).alias("i"), F.lit(None).cast("long").alias("s"), "r")
    rows = written(_beside(t.withColumn("r", F.lit(None).cast("long")).unionByName(sample), s1=("s", 1), r1=("r", 1), r2=("r", 2)), "suffix-ranks", "zstd")
    kind = F.col("i") % 3
    flags = [(kind == 0).cast("long").alias("rest"), (kind != 0).cast("long").alias("sampled")]
    with_first = _less(rows.filter(kind < 2).select("sid", "i", "r", "s", "r1", *flags), ["s", "r1"], ["rest", "sampled"], "suffix-merge")
    with_second = _less(rows.filter(kind != 1).select("sid", "i", "r", "s", "s1", "r2", *flags), ["s", "s1", "r2"], ["rest", "sampled"], "suffix-merge")
    first = with_first.select("sid", "i", (F.col("rest") + F.when(kind == 0, F.col("sampled")).otherwise(F.col("r") - 1)).alias("n"))
    second = with_second.select("sid", "i", F.when(kind == 0, F.col("sampled")).otherwise(F.col("rest") + F.col("r") - 1).alias("n"))
    return first.unionByName(second).groupBy("sid", "i").agg((F.sum("n") + 1).alias("r"))


def _suffixes(texts: DataFrame, least: int, body: bool) -> DataFrame:
    """sid, i and s, a byte + 1, of every suffix of least bytes or more; if body, the first least bytes and its document in place of s."""
    schema = "sid long, i long, doc long, head binary" if body else "sid long, i long, s long"

    def f(batches):
        for b, t in steps(batches):
            sizes = np.diff(t.starts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(t.data)) - t.starts[row]
            at = np.flatnonzero(sizes[row] - place >= least)
            sid = b.column("sid").to_numpy()[row[at]]
            if body:
                doc = b.column("doc").to_numpy()[row[at]]
                heads = np.lib.stride_tricks.sliding_window_view(t.data, least)[at] if len(at) else np.zeros((0, least), np.uint8)
                head = pa.Array.from_buffers(pa.binary(least), len(at), [None, pa.py_buffer(np.ascontiguousarray(heads))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(place[at]), pa.array(doc), head], names=["sid", "i", "doc", "head"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(place[at]), pa.array(t.data[at].astype(np.int64) + 1)], names=["sid", "i", "s"])

    return texts.mapInArrow(f, schema)


def suffix_ranks(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """sid, i and r of every suffix of texts (sid, text): the order of their first span bytes at least, the shorter first."""
    return _ranks(_suffixes(texts, 1, False), 1, span)


def _groups(ordered: DataFrame) -> DataFrame:
    """group, sid, i and doc of the rows in suffix order: neighbours with equal heads have one group."""

    def f(batches):
        part, number, last = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            head = b.column("head")
            new = np.ones(b.num_rows, bool)
            new[1:] = ~np.asarray(pa.compute.equal(head[1:], head[:-1]))
            new[0] = head[0].as_py() != last
            group = number + np.cumsum(new)
            last, number = head[-1].as_py(), int(group[-1])
            opens = pa.compute.if_else(pa.array(new), head, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(group), b.column("sid"), b.column("i"), b.column("doc"), opens], names=["part", "no", "sid", "i", "doc", "head"])

    table = written(ordered.mapInArrow(f, "part int, no long, sid long, i long, doc long, head binary"), "suffix-groups", "zstd")
    parts = table.filter("head is not null").groupBy("part").agg(F.min_by("head", "no").alias("first"), F.max_by("head", "no").alias("last"), F.max("no").alias("n")).orderBy("part").collect()
    goes, last, open_group = [], None, None
    for p in parts:  # a row for each partition: does its first group go on from the one before?
        own = open_group if last is not None and p["first"] == last else [p["part"], 1]
        goes.append((p["part"], *own))
        open_group, last = (own if p["n"] == 1 else [p["part"], p["n"]]), p["last"]
    begin = F.broadcast(table.sparkSession.createDataFrame(goes, "part int, other int, at long"))
    opening = F.col("no") == 1
    group = F.struct(F.when(opening, F.col("other")).otherwise(F.col("part")).alias("part"), F.when(opening, F.col("at")).otherwise(F.col("no")).alias("no"))
    return table.join(begin, "part").select(group.alias("group"), "sid", "i", "doc")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def removed_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of each document, as folio.llm.repeats.removed_repeats."""
    doc = F.col("doc_id").cast("long")
    texts = written(docs.select(F.monotonically_increasing_id().alias("sid"), doc.alias("doc_id"), F.coalesce(doc, F.lit(_LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")), "suffix-texts")
    order = suffix_ranks(texts).join(_suffixes(texts, SPAN, True), ["sid", "i"])
    ordered = order.repartitionByRange(partitions(docs.sparkSession), "r", "sid", "i").sortWithinPartitions("r")
    groups = _groups(ordered.select("sid", "i", "doc", "head"))
    least = groups.groupBy("group").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
    gone = groups.join(least, "group").filter("doc > least").groupBy("sid").agg(F.collect_list("i").alias("starts"))

    def laid(batches):
        for b, t in steps(batches):
            out: list[list] = [[] for _ in range(6)]
            for j, starts in enumerate(b.column("starts").to_pylist()):
                data = t.data[t.starts[j] : t.starts[j + 1]]
                change = np.zeros(len(data) + 1, np.int32)
                at = np.array(starts or [], np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + SPAN, -1)
                covered = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                for c, v in zip(out, [b.column("doc_id")[j].as_py(), len(data), int(covered.sum()), len(spans), hashlib.sha256(data[~covered].tobytes()).hexdigest(), spans]):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return texts.join(gone, "sid", "left").mapInArrow(laid, _OUT)
