"""What the vector operators share: which vectors count, their integers, and blocks of vectors as written rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vectors of a block, the unit that tasks work on; a block is one row of a written table.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector has components and all are neither null nor NaN nor infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def on_grid(values: np.ndarray, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) of all components, as rows of ``dim``; an error where squared distances would not fit 64 bits."""
    grid = np.floor(values.astype(np.float64).reshape(-1, dim) * scale)
    if grid.size and dim * (2 * float(np.abs(grid).max())) ** 2 >= 2**62:
        raise ValueError(f"components too large for exact distances of {dim} dimensions at scale {scale}")
    return grid.astype(np.int64)


def matrices(batches: Iterator[pa.RecordBatch], column: str, scale: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of at most BLOCK rows of the batches, each with the integers of its vectors."""
    for batch in batches:
        parts = -(-batch.num_rows // BLOCK)
        for i in range(parts):
            lo, hi = batch.num_rows * i // parts, batch.num_rows * (i + 1) // parts
            run = batch.slice(lo, hi - lo)
            yield run, on_grid(run.column(column).flatten().to_numpy(zero_copy_only=False), scale, dim)


def packed(column: pa.Array) -> pa.ListArray:
    """A whole column as the single list of a one-row column."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
