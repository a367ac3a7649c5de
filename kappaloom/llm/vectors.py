"""Vectors as matrices of whole numbers, shared by the operators that cluster them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of squares stay below this, so that distances in 64-bit integers are exact.
EXACT = 1 << 60


def is_whole(vector: Column) -> Column:
    """Whether a vector is there, and none of its components is null or not finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow array of lists of `dim` numbers each, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; values whose squared distances might not fit are an error.

    >>> floored(np.array([[0.5, -0.26]]), 4).tolist()
    [[2, -2]]
    """
    scaled = np.floor(values.astype(np.float64) * scale)
    most = float(np.abs(scaled).max()) if scaled.size else 0.0
    if 4 * most * most * max(1, scaled.shape[-1]) >= EXACT:
        raise OverflowError("squared distances of these vectors do not fit in 64 bits")
    return scaled.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    apart = a - b
    return np.einsum("...i,...i->...", apart, apart)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow array of lists."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)), pa.array(rows.ravel(), kind))
