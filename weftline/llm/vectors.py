"""Columns of vectors as matrices, shared by the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(name: str = "embedding") -> Column:
    """The vector as doubles; a negative zero is a zero."""
    return F.transform(F.col(name).cast("array<double>"), lambda x: x + F.lit(0.0))


def whole(name: str = "embedding") -> Column:
    """Whether the vector is there and all its entries are finite numbers."""
    finite = F.forall(F.col(name), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(name).isNotNull() & finite, F.lit(False))


def width(rows: DataFrame, name: str = "embedding") -> int:
    """The length of the longest vector; shorter ones count as filled up with zeros."""
    return rows.agg(F.max(F.size(name))).first()[0] or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column without nulls as an array of ``d`` columns of doubles."""
    n = len(column)
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64) if n else np.zeros(0)
    ends = ends - (ends[0] if n else 0)
    if len(values) == n * d and (np.diff(ends) == d).all():
        return values.reshape(n, d)
    out = np.zeros((n, d))
    size = np.diff(ends)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1], size)] = values
    return out
