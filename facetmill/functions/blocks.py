"""Arrow batches of feature rows as NumPy blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array | pa.ChunkedArray, kind: type | None = np.float64) -> np.ndarray:
    """A column of equally long number arrays as rows, of type ``kind`` or, without it, their own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat if kind is None else flat.astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def arrays(rows: np.ndarray) -> pa.ListArray:
    """Rows of numbers as a column of arrays."""
    rows = np.ascontiguousarray(rows, dtype=np.float64)
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of a column ``part``, arrays of ``size`` doubles as bytes: of shares in a few tasks, then in one, whose result comes to the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    shares = parts.repartition(8).mapInArrow(merge, "part binary")
    return np.frombuffer(shares.repartition(1).mapInArrow(merge, "part binary").first().part)
