"""Helpers of the operators: Arrow batches of bounded size, row keys, worker memory."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.joins import lookup_join
from recordloom.session import stage

#: Bytes of text that a worker handles at once; a longer single text is handled alone.
PART_BYTES = 1 << 20
#: Bits of a row's position in its file.
ROW_BITS = 40


def worker_memory() -> dict:
    """A dictionary that lives as long as the Python worker, for caches that several tasks use."""
    name = "_recordloom_worker_memory"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of ``column`` each."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(size.astype(np.int64)), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def text_list(column: pa.Array) -> list[str]:
    """Python strings; a null counts as an empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column out of concatenated values."""
    return pa.ListArray.from_arrays(pa.array(offsets(lengths), pa.int32()), pa.array(flat, kind))


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``start .. start + length - 1``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long ``name`` per row.

    The number is made of the row's file and its position there, so any plan that reads the
    table again gives the same numbers, on however many executors. What is no scan of a table that knows
    positions (parquet) is written down first. Names of files are joined as a lookup, one small row each.
    """
    taken = {c.lower() for c in df.columns}
    path, row = (next(n for n in (f"_{what}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for what in ("file", "row"))
    place = [F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row)]
    try:
        located = df.select("*", *place)
    except AnalysisException:
        located = stage(df, "rows").select("*", *place)
    files = located.select(path).distinct()
    files = stage(files.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("long").alias(f"{path}_number")), "files")
    located = lookup_join(located, files, path, "inner")
    return located.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftleft(f"{path}_number", ROW_BITS).bitwiseOR(F.col(row)).alias(name))
