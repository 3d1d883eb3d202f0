"""Vectors in Arrow columns and as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds finite numbers only."""
    doubles = vector.cast("array<double>")
    return F.coalesce(
        F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)
    )


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, matrix)`` for each length of vector in a list column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def _cosines(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosines in double precision; null for vectors of different lengths."""
    out = np.full(len(a), np.nan)
    same = np.diff(a.offsets.to_numpy()) == np.diff(b.offsets.to_numpy())
    for rows, x in matrices(a):
        rows, x = rows[same[rows]], x[same[rows]]
        if len(rows):
            at = b.offsets.to_numpy()[rows][:, None] + np.arange(x.shape[1])
            y = b.values.to_numpy(zero_copy_only=False)[at].astype(float)
            x = x.astype(float)
            out[rows] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return pa.array(out, from_pandas=True)


def cosine(a: str, b: str) -> Column:
    return F.arrow_udf(_cosines, "double")(a, b)
