"""Quality classifier with hierarchical empirical Bayes.

A logistic model over surface features of a text (word lengths, letter case, symbols, repeated words,
lines) is fitted to a bounded sample of labelled rows (TRAIN_ROWS, by a hash of doc_id). Its
probabilities over all documents are summed by site (host) and by path (section of a site); Beta priors
for sites around the corpus mean, and for paths around their site, get their strength from the
spread between groups (method of moments over grouped sums). A document's posterior odds are its
own odds times the odds that the rest of its path (the document itself left out) has against the corpus mean; sparse
sites and paths stay near the mean.

Defined cases: a null or empty text has features of an empty text; a null host or path counts as an empty
string; without labels of both kinds (none at all, or none that joins) nothing is rejected; a null doc_id joins no label
and is scored like others; repeated rows count as often as they occur, and of repeated labels each is fitted to; empty
tables give an empty result; further columns are left alone, whatever their names; a text longer than a step (STEP_BYTES) is a step of its own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folio.llm.shared import Texts, met, numbered, renamed, steps, words, written

#: Labelled rows that the model is fitted to, at most.
TRAIN_ROWS = 20_000
KEEP = 0.5
#: Numbers that features gives for a text.
FEATURES = 14

_CLASS = np.zeros((6, 256), np.uint8)  # upper, lower, digit, symbol, newline, other bytes
_CLASS[0, 65:91] = 1
_CLASS[1, 97:123] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[4, 10] = 1
_CLASS[5, 128:] = 1


def features(texts: Texts) -> np.ndarray:
    """A row of numbers for each text."""
    data, starts = texts
    n = len(starts) - 1
    w = words(texts, lower=True)
    size = np.diff(starts).astype(float)
    count = np.diff(w.first).astype(float)

    def by_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1)
        np.cumsum(values, out=total[1:])
        return total[edges[1:]] - total[edges[:-1]]

    upper, lower, digit, symbol, line, other = (by_row(_CLASS[i][data], starts) for i in range(6))
    letters = upper + lower + other
    length = (w.end - w.start).astype(float)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    bare = np.zeros(len(w.hash))  # words that are symbols only
    marks = _CLASS[3][data]
    held = np.zeros(len(data) + 1, np.int64)
    np.cumsum(marks, out=held[1:])
    inside = held[w.end] - held[w.start]
    bare[:] = inside == (w.end - w.start)
    noisy = (inside >= 2).astype(float)
    key = np.sort((w.row.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    first = np.ones(len(key))
    first[1:] = key[1:] != key[:-1]
    distinct = by_row(first, w.first)
    some, many = np.maximum(count, 1), np.maximum(size, 1)
    out = [
        np.log1p(count), by_row(length, w.first) / some, upper / np.maximum(letters, 1), digit / many, symbol / many, line / many,
        by_row(same, w.first) / some, by_row(bare, w.first) / some, by_row(noisy, w.first) / some, distinct / some, distinct / np.sqrt(some),
        (upper / np.maximum(letters, 1) > 0.5).astype(float), (count == 0).astype(float), other / many,
    ]
    return np.stack(out, axis=1) if n else np.zeros((0, FEATURES))


class Model(NamedTuple):
    """Standardisation and weights, the bias last."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model | None:
    """Logistic regression by Newton's method; None unless both kinds occur."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    weights = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, weights)


def train(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits the model to at most rows labelled documents; what the driver gets is their features."""
    chosen = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # rows are bounded by the parameter

    def f(batches):
        for batch, part in steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(features(part)), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # of rows that repeat an id, those with the smallest features: at most rows, whatever the order of rows
    found = texts.mapInArrow(f, "doc_id long, y double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(rows).toPandas()
    return fit(np.array(found["x"].tolist(), float).reshape(len(found), FEATURES), found["y"].to_numpy())


def _append(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with the column p, the model's probability (1 without a model)."""

    def f(batches):
        for batch, part in steps(batches, text):
            p = model.probability(features(part)) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p"])

    return docs.mapInArrow(f, StructType([*docs.schema.fields, StructField("p", DoubleType())]))


def _strength(groups: DataFrame, parent_mean: Column) -> float:
    """Prior rows that the Beta prior of groups (n, s, q: rows, sum, sum of squares) is worth; one row reaches the driver."""
    mean = F.col("s") / F.col("n")
    a = groups.select("n", "s", "q", mean.alias("mean"), parent_mean.alias("prior")).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("q") - F.col("s") * F.col("mean")).alias("within"), F.sum(F.col("n") * (F.col("mean") - F.col("prior")) ** 2).alias("between"),
    ).first()
    if not a.n or a.k < 2 or a.n <= a.k:
        return 10.0
    m = min(max(a.s / a.n, 1e-6), 1 - 1e-6)
    noise = max(a.within, 0.0) / (a.n - a.k)
    spread = (a.between - (a.k - 1) * noise) / max(a.n - a.nn / a.n, 1.0)
    return float(min(max(m * (1 - m) / spread - 1, 1.0), 1e5)) if spread > 0 else 1e5


class Priors(NamedTuple):
    """paths: host, path, sums of the path (n, s) and its site's posterior mean; the corpus mean and the paths' strength."""

    paths: DataFrame
    mean: float
    strength: float


def priors(scored: DataFrame) -> Priors:
    """From host, path and p of all documents, by grouped sums."""
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 1e-4), 1 - 1e-4) if total.n else 0.5
    k = _strength(hosts, F.lit(mean))
    site = hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("site_posterior"))
    paths = paths.join(site, "host")
    strength = _strength(paths, F.col("site_posterior"))
    return Priors(written(paths.drop("q"), "quality-priors"), mean, strength)


def _met(rows: DataFrame, p: Priors) -> DataFrame:
    """rows (with host and path) beside the sums of their path; paths that a ten-thousandth of all rows have are broadcast."""
    total = p.paths.agg(F.sum("n")).first()[0] or 0
    return met(rows, p.paths.withColumn("m", F.col("n")), ["host", "path"], total).drop("m")


def _decided(scored: DataFrame, p: Priors, keep: float) -> DataFrame:
    """scored (p, and n, s and site_posterior of the path) with path_posterior, probability and keep."""
    own = F.least(F.greatest(F.col("p"), F.lit(1e-9)), F.lit(1 - 1e-9))
    path = (F.col("s") - F.col("p") + p.strength * F.col("site_posterior")) / (F.col("n") - 1 + p.strength)
    path = F.least(F.greatest(path, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.log(own / (1 - own)) + F.log(F.col("path_posterior") / (1 - F.col("path_posterior"))) - float(np.log(p.mean / (1 - p.mean)))
    return scored.withColumn("path_posterior", path).withColumn("probability", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("probability") >= keep)


def _keys(host: Column, path: Column) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("")) for c in (host, path)]


def classify(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """doc_id, evidence (the text's own probability), site_posterior, path_posterior, probability and keep of each document."""
    model = train(docs, labels, rows=rows)
    own, part = _keys(host, path)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("host"), part.alias("path"))
    scored = written(_append(slim, model).drop("text"), "quality-scores")
    p = priors(scored)
    found = _decided(_met(scored, p), p, keep)
    return found.select("doc_id", F.col("p").alias("evidence"), "site_posterior", "path_posterior", "probability", "keep")


def kept_documents(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """The rows of docs that are kept, all columns. Sums come from a first pass; in the second rows meet their path's before they are scored, once each.

    A null or empty text is judged by its site and path as well; of rows with equal probability none is preferred, all at keep or above stay.
    """
    model = train(docs, labels, rows=rows)
    keyed, name = numbered(docs, *_keys(host, path))
    keyed = keyed.withColumnsRenamed({"m0": "host", "m1": "path"})
    p = priors(_append(keyed.select(name["text"], "host", "path"), model, name["text"]).drop(name["text"]))
    return renamed(_decided(_append(_met(keyed, p), model, name["text"]), p, keep).filter("keep"), docs)
