"""Vector columns in tasks: matrices out of Arrow lists, and whole groups of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(all values, n+1 offsets) of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    return values, at - at[0]


def by_size(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for every length of vector in the column."""
    values, at = lists(column)
    size = np.diff(at)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, values[at[:-1][rows][:, None] + np.arange(d)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision at length 1; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        start = 0
        for cut in [*np.flatnonzero(new).tolist(), n]:
            if cut > start:
                held.append(batch.slice(start, cut - start))
            if cut < n:
                if held:
                    yield pa.Table.from_batches(held)
                held, start = [], cut
    if held:
        yield pa.Table.from_batches(held)
