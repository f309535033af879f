"""Vector expressions (V1-V4, V6, V11, A10, A11, A13). All sums are doubles in the JVM."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Numbers = Sequence[float]


def literal(vector: Numbers) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def as_matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Lists of ``dimension`` doubles as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def sums_in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows, component after component: the doubles that ``dot`` gives."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def slack(dimension: int) -> float:
    """How far two ways of summing an inner product in doubles can be apart, as a share of the product of norms.

    Each way is off by n * u / (1 - n * u) of the sum of the products' sizes at most (u = 2^-53, n operations in any order),
    and that sum is at most the product of the norms; some room covers the norms' own rounding.
    """
    n = dimension + 2
    return 2 * n * 2.0**-53 / (1 - n * 2.0**-53) * (1 + 1e-6)


def dot(a: Column, b: Column) -> Column:
    """V2. The sizes must be equal: filter on them first, since a shorter side would count as nulls."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """A10."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """V1: a zero or non-finite vector fails."""
    n = norm(v)
    ok = n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < F.lit(float("inf")))
    safe = F.when(ok, n).otherwise(F.raise_error(F.lit("a zero or non-finite vector can't be normalized")).cast("double"))
    return F.transform(v, lambda x: x.cast("double") / safe)


def cosine(a: Column, b: Column) -> Column:
    """rows' cosine with a floor under the product of norms."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def unit(vector: Numbers) -> np.ndarray:
    """V1 on the driver, for a query."""
    v = np.asarray(vector, float)
    n = math.sqrt(float((v * v).sum()))
    if not math.isfinite(n) or n == 0:
        raise ValueError("a zero or non-finite vector can't be normalized")
    return v / n


def compose(text: Numbers | None, references: Sequence[Numbers] = ()) -> np.ndarray:
    """Text and the references together weigh the same; every part is a unit vector first."""
    parts = [] if text is None else [text]
    parts = [*parts, *references]
    if not parts:
        raise ValueError("enter a text or choose a reference photo")
    if len({len(p) for p in parts}) > 1 or not len(parts[0]):
        raise ValueError("reference embedding dimensions differ")
    units = [unit(p) for p in parts]
    if text is None or not references:
        return unit(np.mean(units, axis=0))
    return unit(0.5 * units[0] + 0.5 * np.mean(units[1:], axis=0))


@F.pandas_udf(T.BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    """V3: little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def _decoded(blob: bytes, dimension: int) -> np.ndarray:
    if dimension <= 0 or len(blob) != 4 * dimension:
        raise ValueError(f"{len(blob)} bytes aren't {dimension} floats")
    return np.frombuffer(blob, "<f4")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blobs: pd.Series, dimensions: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else _decoded(b, int(d)) for b, d in zip(blobs, dimensions, strict=True)])


def encoded_dot(query: Numbers):
    """V4: a column function of (bytes, dimension); a batch is one matrix product."""
    q = np.asarray(query, float)

    @F.pandas_udf(T.DoubleType())
    def product(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for blobs, dimensions in batches:
            if ((dimensions != len(q)) | (blobs.map(len) != 4 * len(q))).any():
                raise ValueError(f"embeddings must have {len(q)} floats")
            yield pd.Series(np.frombuffer(b"".join(blobs), "<f4").reshape(-1, len(q)).astype(float) @ q)

    return product


def fidelity(a: Column, b: Column) -> list[Column]:
    """Agreement of two encoders over rows, and whether it reaches the accepted limits."""
    error = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    least, worst = F.min(cosine(a, b)), F.max(F.array_max(error))
    mean = F.avg(F.aggregate(error, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    # fixed limits: cosine 0.9999, absolute error 0.001
    return [least.alias("min_cosine"), F.avg(cosine(a, b)).alias("mean_cosine"), worst.alias("max_error"), mean.alias("mean_error"), ((least >= 0.9999) & (worst <= 1e-3)).alias("accepted")]
