"""Vectors from Arrow batches as numpy arrays, and the rows that take part in vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str = "embedding") -> Column:
    """Vectors that aren't null, empty or zero and hold neither null nor non-finite components."""
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(column, lambda x: x != 0)
    return F.coalesce((F.size(column) > 0) & ~odd & some, F.lit(False))


def usable_rows(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Columns vec_id (long), embedding (array<double>) of the rows that take part.

    Vectors whose length isn't the most frequent one (of equally frequent ones the smallest)
    take no part either.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable())
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.filter(F.size("embedding") == (lengths["length"] if lengths else 0))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list array of one length as float64."""
    if not len(lists):
        return np.zeros((0, 0))
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def directions(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square overflows."""
    if not len(rows):
        return rows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def list_array(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1), kind))
