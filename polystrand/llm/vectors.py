"""Vectors as rows: which ones take part, and classes of equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame) -> DataFrame:
    """``rows`` without vectors that are null, empty, zero or hold null or non-finite
    components, and with ``dim``, their length."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nonzero = F.exists(x, lambda v: v != 0)
    return rows.where(F.col("embedding").isNotNull() & finite & nonzero).withColumn("dim", F.size("embedding"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of lists of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that no square leaves the range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
