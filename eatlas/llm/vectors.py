"""Embeddings as matrices, and which rows take part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(embedding: str = "embedding") -> Column:
    """The vector, or null if it is null, empty, zero or holds null or non-finite components."""
    values = F.col(embedding).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.when(finite & F.exists(values, lambda x: x != 0.0), values)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a column of vectors without nulls."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    begin = np.cumsum(lengths) - lengths
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield rows, flat[begin[rows][:, None] + np.arange(length)]
