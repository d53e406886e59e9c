"""Vectors of a table for the searches: which of them take part, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, with no null and no non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def rows_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id long, vector array<double>`` of the vectors that take part."""
    rows = df.select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.array([], pa.list_(pa.float64()))
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width or 0, int(sizes.max()) if len(sizes) else 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out
