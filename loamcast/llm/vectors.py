"""Embedding columns as matrices of integers, for whole batches at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers of a larger magnitude are cut to this one; finite entries of a float column may be far larger.
LARGEST = 1 << 52
ROWS = 8192  # rows of a block of matrix work


def finite(name: str) -> Column:
    """Whether an array is there and all its entries are finite numbers."""
    entries = F.forall(name, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(entries, F.lit(False))


def floors(name: str, scale: int, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of each entry, as double before, as long after."""
    return F.transform(name, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)) + F.lit(shift))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length as an int64 matrix."""
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(-1, width)


def blocks(batches: Iterator[pa.RecordBatch], width: int, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their matrix), a bounded number of numbers at a time."""
    step = max(1, min(ROWS, (1 << 22) // max(1, width)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield part, matrix(part.column(column), width)


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of columns, as Python integers."""
    safe = not len(x) or len(x) * int(np.abs(x).max()) < 1 << 62
    return (x if safe else x.astype(object)).sum(axis=0).astype(object)


def combined(parts: DataFrame, zero, add: Callable, read: Callable):
    """The one-column binary rows of `parts`, read and added up in a tree, so
    that the driver gets a handful of them and no task more than eight."""
    rdd = parts.rdd.map(lambda row: read(bytes(row[0])))
    count, depth = rdd.getNumPartitions(), 2
    while 8**depth < count:
        depth += 1
    return rdd.treeAggregate(zero, add, add, depth)
