"""Embeddings as integer vectors: floor(scale * x) of each component, kept as little-endian 32-bit integers.

A row takes part if its vector is there and all its components are finite numbers. Components beyond ``LIMIT`` are
refused with an error: up to it sums of 2,048 products, and of squares of differences, fit into 64 bits, so that nothing
wraps round. Vectors may differ in length; a shorter one counts as followed by zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 26


def scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array<double> column: all rows' components after another as 32-bit integers, each row's bounds in them, and whether
    the row takes part (the others' components are zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    finite = np.isfinite(values)
    wrong = np.concatenate([[0], np.cumsum(~finite)])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[bounds[1:]] == wrong[bounds[:-1]])
    values = np.floor(np.where(finite & np.repeat(good, sizes), values, 0.0) * scale)
    if len(values) and np.abs(values).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT / scale} can't be scored in 64 bits")
    return values.astype("<i4"), bounds, good


def quantised(rows: DataFrame, scale: int, carried: str = "label") -> DataFrame:
    """vec_id, ``carried`` and ``vector`` (binary) of the rows that take part, and ``size``, the number of components."""
    kind = rows.schema[carried].dataType.simpleString()
    kept = rows.where("embedding is not null").select(F.col("vec_id").cast("long"), carried, F.col("embedding").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds, good = scaled(batch.column("embedding"), scale)
            sizes = np.diff(bounds)
            vectors = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(bounds * 4), pa.py_buffer(values.tobytes())]).cast(pa.binary())
            columns = [batch.column("vec_id"), batch.column(carried), vectors, pa.array(sizes.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", carried, "vector", "size"]).filter(pa.array(good))

    return kept.mapInArrow(run, f"vec_id long, {carried} {kind}, vector binary, size int")


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a binary column as rows of 64-bit integers, with zeros up to ``dimension``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, dimension), np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    values, sizes = raw.view("<i4"), np.diff(bounds) // 4
    if (sizes == dimension).all():
        return values.reshape(-1, dimension).astype(np.int64)
    out = np.zeros((len(column), dimension), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
