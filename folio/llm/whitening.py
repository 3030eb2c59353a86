"""Whitening of embeddings by a singular value decomposition of centred distributed rows.

Components become integers; one pass gives their number, sums and sums of squares by dimension, exactly. The rows less their
mean go, as a DataFrame of vectors, to MLlib's RowMatrix.computeSVD, which sums the products of the dimensions over all
executors and returns singular values s and right vectors. The covariance's eigenvalues are s**2 / n, its unit eigenvectors the
right vectors. The trace comes from the exact sums: the deviations of all rows add up to n * (n * squares - sums**2). A
second pass sums the covariance of the whitened rows, centred within each task, for identity_error; a third returns the rows.

Asked for more than half of the dimensions, computeSVD decomposes the products in double precision on the driver (dimension**2 numbers,
whatever the rows) instead of iterating over the rows; so at least so many are asked for and the first are kept.

Defined cases: a vector that is null or holds a null or a number that isn't finite is dropped, and so is one of another length than
the most frequent (of equally frequent lengths the least); a component whose singular value is below R_COND of the largest has no variance that
double precision can tell from none, and is left out, so equal rows alone give an empty result; deviation is null where it is beyond
a long; rows that repeat count each; a null vec_id is a row like others; components of one eigenvalue come in any order; an empty table gives an empty result; integers
beyond 2**31 - 1 saturate; further columns are left out of the result, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from folio.llm.vectors import kept, matrix

COMPONENTS = 32
SCALE = 64
#: Added to the integers; the whitened rows and deviations don't depend on it.
OFFSET = 1_000_000
#: Singular values below this share of the largest are those of no variance: their squares drown in the rounding of the largest one's.
R_COND = 1e-6
_LONG = (1 << 63) - 1


class Whitener(NamedTuple):
    """n rows; sums of the integers by dimension; a column for each component: unit eigenvectors; their eigenvalues; trace of the covariance; whether products fit a long."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    narrow: bool

    def centred(self, y: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Rows less their mean, and n**2 times their squared length, exactly (None beyond a long)."""
        if self.narrow:
            z = self.n * y.astype(np.int64) - np.array(self.sums, np.int64)
            return z / self.n, (z * z).sum(axis=1).tolist()
        z = self.n * y.astype(object) - np.array(self.sums, object)
        exact = [int(x) for x in (z * z).sum(axis=1)]
        return (z / self.n).astype(float), [x if x <= _LONG else None for x in exact]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.vectors / np.sqrt(self.values))


def fit(rows: DataFrame, n: int, d: int, most: int, components: int = COMPONENTS) -> Whitener:
    """From a table of arrays y of d integers, n rows, none beyond most; what reaches the driver is a row for each dimension."""
    square = F.col("x").cast("long") * F.col("x")
    low = 1 << 30
    held = rows.select(F.posexplode("y").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("s"), F.sum(F.shiftright(square, 30)).alias("high"), F.sum(square.bitwiseAND(low - 1)).alias("low")).orderBy("place").collect()
    sums, squares = [r.s for r in held], [r.high * low + r.low for r in held]
    trace = Fraction(sum(n * q - s * s for s, q in zip(sums, squares)), n * n)
    narrow = d * (2 * n * most) ** 2 <= _LONG
    if not trace:
        return Whitener(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, narrow)
    total = F.lit(sums)
    # exact before the division wherever the products fit a long
    shifted = F.zip_with("y", total, lambda y, s: (y.cast("long") * n - s) / n if narrow else y - s / n)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(shifted).alias("v")), "v")
    found = RowMatrix(vectors, n, d).computeSVD(min(d, max(components, d // 2 + 1)), computeU=False, rCond=R_COND)
    s = found.s.toArray()
    values = s * s / n
    own = found.V.toArray()[:, : len(s)]
    fine = s >= R_COND * s[0]
    own, values = own[:, fine][:, :components], values[fine][:components]
    own = own * np.where(own[np.abs(own).argmax(axis=0), np.arange(own.shape[1])] < 0, -1.0, 1.0)
    return Whitener(n, sums, own, values, float(trace), narrow)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(w.values)

    def sums(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = w.whitened(w.centred(matrix(batch.column("y"), len(w.sums)))[0])
            if not len(x):
                continue
            own = x.mean(axis=0)
            away, apart = x - own, own - mean
            spread += away.T @ away + np.outer(apart, apart) * (n * len(x) / (n + len(x)))
            mean, n = mean + apart * (len(x) / (n + len(x))), n + len(x)
        if n:
            # about 0, the mean of all rows but for rounding
            i, j = np.triu_indices(k)
            at = np.concatenate([i, np.arange(k)]), np.concatenate([j, np.full(k, -1)])
            value = np.concatenate([(spread + n * np.outer(mean, mean))[i, j], n * mean])
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(value)], names=["i", "j", "v"])

    found = {(r.i, r.j): r.v / w.n for r in rows.select("y").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}  # components**2 rows
    return max(abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0)


def whiten(vectors: DataFrame, *, vec_id: Column, vector: Column, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each usable row and component."""
    own = kept(vectors, "whitening-vectors", scale, vec_id=vec_id, vector=vector)
    kind = own.rows.schema["id"].dataType
    schema = StructType([StructField("vec_id", kind), StructField("component", IntegerType()), *[StructField("n", LongType()), StructField("deviation", LongType())], *[StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    w = fit(own.rows, own.n, own.d, own.most, components) if own.n else None
    if w is None or not len(w.values):
        return own.rows.sparkSession.createDataFrame([], schema)
    error, explained, k = identity_error(own.rows, w), w.values / w.trace, len(w.values)

    def f(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                centred, deviation = w.centred(matrix(some.column("y"), len(w.sums)))
                rows = np.repeat(np.arange(some.num_rows), k)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), some.num_rows)), pa.array(np.full(len(rows), w.n)), pa.array(deviation, pa.int64()).take(at), pa.array(w.whitened(centred).reshape(-1)), pa.array(np.tile(explained, some.num_rows)), pa.array(np.full(len(rows), error))],
                    names=schema.names,
                )

    return own.rows.select("id", "y").mapInArrow(f, schema)
