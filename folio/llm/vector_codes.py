"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Components become integers; vectors are cut into PARTS consecutive parts. Equal parts of a position are first
counted, so the weighted rounds of Lloyd's method run over distinct values only: a task finds the nearest entry of
its distinct parts and sums them by entry, times their counts, in integers; Spark adds up these sums. What reaches the driver
is the codebooks (PARTS * ENTRIES rows of numbers), whatever the data. At last the codes and squared errors of the
distinct parts go back to the vectors by a join on position and part, and to each vector by its number. Parts and labels
that a ten-thousandth of all rows have are told by a broadcast, so none is gathered in one task.

All arithmetic is exact: in doubles while every sum of products stays below 2**53, else in Python's integers.

Defined cases: a vector that is null or holds a null or a number that isn't finite is dropped, and so is one of another length than
the most frequent (of equally frequent lengths the least); a length that PARTS doesn't divide is cut at j * length // PARTS; with
fewer rows than ENTRIES a codebook has an entry for each row; rows that repeat a vec_id count each, ordered by their
vectors; a null vec_id comes behind all others; null labels are one label; an empty table gives an empty result; integers
beyond 2**31 - 1 saturate; further columns are left out of the result, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import met, written
from folio.llm.vectors import kept, matrix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024


def nearest(x: np.ndarray, entries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, of equally near ones the first, and its squared distance; most: the largest absolute number."""
    at, away = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if 4 * max(1, x.shape[1]) * most * most < 1 << 53:
        c = entries.astype(float)
        own = (c * c).sum(axis=1)
        for i in range(0, len(x), 4096):
            some = x[i : i + 4096].astype(float)
            d = own - 2 * (some @ c.T)
            at[i : i + 4096] = best = d.argmin(axis=1)
            away[i : i + 4096] = d[np.arange(len(some)), best] + (some * some).sum(axis=1)
        return at, away
    c = entries.astype(object)
    for i, row in enumerate(x.astype(object)):
        d = [sum((a - b) ** 2 for a, b in zip(row, e)) for e in c]
        at[i] = best = min(range(len(d)), key=d.__getitem__)
        away[i] = min(d[best], (1 << 63) - 1)
    return at, away


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray]):
    """Position, its rows' numbers and their parts, for each position in the batch."""
    pos, parts = batch.column("pos").to_numpy(), batch.column("part")
    for p in np.unique(pos):
        own = np.flatnonzero(pos == p)
        yield p, own, matrix(parts.take(pa.array(own)), books[p].shape[1])


def _moved(distinct: DataFrame, books: list[np.ndarray], most: int) -> list[np.ndarray]:
    """One round: the codebooks with each entry that has parts replaced by their floored mean."""

    def sums(batches):
        total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            m = batch.column("m").to_numpy()
            for p, own, x in _by_position(batch, books):
                at, _ = nearest(x, books[p], most)
                np.add.at(total[p], at, np.hstack([x * m[own][:, None], m[own][:, None]]).astype(np.int64))
        for p, t in enumerate(total):
            if len(some := np.flatnonzero(t[:, -1])):
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(list(t[some]), pa.list_(pa.int64()))], names=["pos", "entry", "sums"])

    found = distinct.mapInArrow(sums, "pos int, entry int, sums array<long>").select("pos", "entry", F.posexplode("sums").alias("place", "s"))
    moved = [b.copy() for b in books]
    held = {(r.pos, r.entry, r.place): r.s for r in found.groupBy("pos", "entry", "place").agg(F.sum("s").alias("s")).collect()}  # the codebooks' size
    for (p, entry, place), s in held.items():
        if place < (w := books[p].shape[1]):
            moved[p][entry, place] = s // held[p, entry, w]
    return moved


def codebooks(vectors: DataFrame, distinct: DataFrame, edges: list[int], most: int, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each position: at first the parts of the rows with the smallest ids, then moved by weighted rounds."""
    first = np.array([r.y for r in vectors.orderBy(F.asc_nulls_last("id"), "y").select("y").limit(entries).collect()], np.int64)
    books = [first[:, a:b] for a, b in zip(edges, edges[1:])]
    for _ in range(rounds):
        books = _moved(distinct, books, most)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all numbers by position, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()


_RESULT = "code string, error long, label_error long, codebooks_sha256 string"


def compress(
    vectors: DataFrame, *, vec_id: Column, vector: Column, label: Column, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of each usable row."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits: 1 to 256 entries")
    own = kept(vectors, "codes-vectors", scale, vec_id=vec_id, vector=vector, label=label)
    if not own.n:
        return own.rows.selectExpr("id AS vec_id", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in _RESULT.split(", ")])
    edges = [j * own.d // parts for j in range(parts + 1)]
    cut = F.array(*[F.slice("y", a + 1, b - a) for a, b in zip(edges, edges[1:])])
    parted = own.rows.select("row", "id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = written(parted.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("m")), "codes-distinct")
    books = codebooks(own.rows, distinct, edges, own.most, entries=entries, rounds=rounds)

    most = own.most

    def assign(batches):
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, x in _by_position(batch, books):
                code[at], error[at] = nearest(x, books[p], most)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=[*batch.schema.names, "code", "error"])

    coded = written(distinct.mapInArrow(assign, "pos int, part array<int>, m long, code int, error long"), "codes-parts")
    each = met(parted, coded, ["pos", "part"], parts * own.n)
    hexed = F.lpad(F.lower(F.hex("code")), 2, "0")
    code = F.concat(*[F.max(F.when(F.col("pos") == j, hexed)) for j in range(parts)])
    whole = each.groupBy("row", "id", "label").agg(code.alias("code"), F.sum("error").alias("error"))
    whole = written(whole.select("id", F.coalesce("label", F.lit("")).alias("label"), F.isnull("label").alias("unlabelled"), "code", "error"), "codes-rows")
    labels = written(whole.groupBy("label", "unlabelled").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("m")), "codes-labels")
    found = met(whole, labels, ["label", "unlabelled"], own.n)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL for the same columns over embeddings, each round a step; for lengths that parts divides."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT d.pos, d.part, d.m, min({{'away': d.own - 2 * list_dot_product(d.x, b.x) + b.own, 'entry': b.entry}}) AS best
  FROM dist d JOIN book{i} b USING (pos) GROUP BY d.pos, d.part, d.m
)""")
        if i < rounds:
            steps.append(f"""sums{i} AS (
  SELECT pos, entry, place, sum(m * x)::BIGINT AS s, sum(m)::BIGINT AS n
  FROM (SELECT pos, best.entry AS entry, m, unnest(part) AS x, generate_subscripts(part, 1) AS place FROM near{i}) GROUP BY pos, entry, place
), means{i} AS (
  SELECT pos, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS part FROM sums{i} GROUP BY pos, entry
), book{i + 1} AS MATERIALIZED (
  SELECT pos, entry, part, part::DOUBLE[] AS x, list_dot_product(part::DOUBLE[], part::DOUBLE[]) AS own
  FROM (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM book{i} b LEFT JOIN means{i} m USING (pos, entry))
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS y
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parted AS MATERIALIZED (
  SELECT vec_id, label, p AS pos, y[p * (len(y) // {parts}) + 1 : (p + 1) * (len(y) // {parts})] AS part FROM kept, range({parts}) t(p)
), dist AS MATERIALIZED (
  SELECT pos, part, count(*) AS m, part::DOUBLE[] AS x, list_dot_product(part::DOUBLE[], part::DOUBLE[]) AS own FROM parted GROUP BY pos, part
), book0 AS MATERIALIZED (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, part, part::DOUBLE[] AS x, list_dot_product(part::DOUBLE[], part::DOUBLE[]) AS own
  FROM parted WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), {", ".join(steps)}, coded AS (
  SELECT p.vec_id, p.label, string_agg(lpad(lower(hex(n.best.entry)), 2, '0'), '' ORDER BY p.pos) AS code, sum(n.best.away)::BIGINT AS error
  FROM parted p JOIN near{rounds} n USING (pos, part) GROUP BY p.vec_id, p.label
), digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, place)) AS codebooks_sha256
  FROM (SELECT pos, entry, unnest(part) AS x, generate_subscripts(part, 1) AS place FROM book{rounds})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""
