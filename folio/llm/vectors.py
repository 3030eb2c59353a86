"""Vectors as rows of integers, for the operators on embeddings."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import written

#: Integers beyond this saturate.
MOST = (1 << 31) - 1


class Kept(NamedTuple):
    """rows (row, id, label, y): a written table of vectors of one length; their number n, their length d, the largest absolute integer."""

    rows: DataFrame
    n: int
    d: int
    most: int


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * component) of each component, as int; beyond MOST they saturate."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def kept(vectors: DataFrame, name: str, scale: int, *, vec_id: Column, vector: Column, label: Column | None = None) -> Kept:
    """The usable rows, written once with a number (row) of their own.

    Vectors of another length than the most frequent one (of equally frequent ones the least) fit no other vector and count as unusable.
    """
    rows = vectors.select(vec_id.alias("id"), (F.lit(None) if label is None else label).cast("string").alias("label"), vector.alias("v")).filter(usable(F.col("v")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", integers(F.col("v"), scale).alias("y"))
    rows = written(rows.withColumn("d", F.size("y")).withColumn("most", F.coalesce(F.array_max(F.transform("y", F.abs)), F.lit(0))), name)
    found = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), "d").first()
    if found is None:
        return Kept(rows.drop("d", "most"), 0, 0, 0)
    return Kept(rows.filter(F.col("d") == found.d).drop("d", "most"), found.n, found.d, found.most)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of d numbers each as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
