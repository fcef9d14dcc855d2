"""Vectors as integers, for the operators that compute with them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_DOUBLE, EXACT_LONG = 1 << 53, 1 << 62


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each component, as long; null for a vector that is null or empty or
    holds a null or non-finite component. Beyond the range of a long: its ends."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(v) > 0), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x)))


def usual_size(rows: DataFrame, column: str) -> int | None:
    """The most frequent number of components (the smaller one, if two are), or None."""
    first = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), "size").first()
    return first and first["size"]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """An Arrow column of lists of ``size`` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def products(rows: np.ndarray, one: np.ndarray, bound: int) -> np.ndarray:
    """Exact integer inner products; ``bound``: on the sum of the products' sizes. Beyond the range
    of a long: its ends."""
    if bound < EXACT_DOUBLE:
        return (rows.astype(np.float64) @ one.astype(np.float64)).astype(np.int64)
    if bound < EXACT_LONG:
        return rows @ one
    exact = rows.astype(object) @ one.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in exact.tolist()], np.int64)
