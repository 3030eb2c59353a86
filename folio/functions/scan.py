"""Functions from a row to any number of rows, on Arrow batches: what a row gives is laid end to end, its other columns are repeated by index. Functions of such rows, which stand together, as a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


#: Rows found after which a batch is given on; what one row gives stays together.
ROWS = 4096


def scanned(rows: DataFrame, inputs: list[str], keep: list[str], scan: Callable[..., Iterable[tuple]], fields: str, limit: int = ROWS) -> DataFrame:
    """The columns keep of each row beside each tuple (fields, as DDL) that scan gives for its columns inputs.

    A task holds the inputs of one row as Python objects, and limit of the rows found (more only where one row gives more), whatever the batches' size.
    """
    more = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in more]

    def batch(b: pa.RecordBatch, start: int, counts: list[int], found: list[tuple]) -> pa.RecordBatch:
        at = pa.array(np.repeat(np.arange(start, start + len(counts)), counts))
        columns = zip(*found) if found else [()] * len(kinds)
        arrays = [b.column(c).take(at) for c in keep] + [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=[*keep, *more.names])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = [b.column(c) for c in inputs]
            start, counts, found = 0, [], []
            for i in range(b.num_rows):
                before = len(found)
                found.extend(scan(*(c[i].as_py() for c in given)))
                counts.append(len(found) - before)
                if len(found) >= limit:
                    yield batch(b, start, counts, found)
                    start, counts, found = i + 1, [], []
            if found:
                yield batch(b, start, counts, found)

    schema = StructType([*[rows.schema[c] for c in keep], *more.fields])
    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(f, schema)


def together(rows: DataFrame, index: str, inputs: list[str], keep: list[str], look: Callable[..., tuple[list, ...]], fields: str) -> DataFrame:
    """The columns keep of each row beside what look gives (lists of columns by fields, as DDL) for its group: look gets lists of the columns inputs.

    Rows of a group stand together in a task, as scanned gives them; one begins where index is 0 or null. Row follows row, so nothing is shuffled or sorted:
    a task holds one group, and of others no more than a batch.
    """
    more = StructType.fromDDL(fields)
    kinds = [to_arrow_type(f.dataType) for f in more]

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches that hold whole groups as one, with what look gives for each group."""
        b = pa.concat_batches(parts)
        if not b.num_rows:
            return
        given = [b.column(c).to_pandas(integer_object_nulls=True).tolist() for c in inputs]  # a list at once: to_pylist makes a scalar of each value
        starts = begins(b)
        found: list[list] = [[] for _ in kinds]
        for start, end in zip(starts, [*starts[1:], b.num_rows]):
            for all_of, some in zip(found, look(*(c[start:end] for c in given))):
                all_of.extend(some)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, kind) for c, kind in zip(found, kinds))], names=[*keep, *more.names])

    def begins(b: pa.RecordBatch) -> list[int]:
        return np.flatnonzero(b.column(index).fill_null(0).to_numpy(zero_copy_only=False) == 0).tolist()

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # a group that may go on
        for b in batches:
            starts = begins(b)
            if starts:
                yield from whole([*held, b.slice(0, starts[-1])])
                held, b = [], b.slice(starts[-1])
            held.append(b)
        if held:
            yield from whole(held)

    schema = StructType([*[rows.schema[c] for c in keep], *more.fields])
    return rows.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(f, schema)
