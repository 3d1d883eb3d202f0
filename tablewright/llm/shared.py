"""What the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def importable(spark: SparkSession) -> None:
    """Let the Python workers of a session find this package where the driver found it.

    A cluster has the library installed; this is for sessions started in another folder.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])


def c(name: str) -> Column:
    """The column called exactly ``name``."""
    return F.col(quoted(name))


def whole_text(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(c(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lowered and every other character left alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` is called so (in any case)."""
    taken = {n.lower() for n in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def row_key(id_column: Column, text: Column) -> Column:
    """A value that tells rows apart: rows that share it have the same id and the same text."""
    return F.md5(F.concat_ws("\x1f", id_column.cast("string"), F.md5(text.cast("binary"))))


def text_batches(tables: Iterator[pa.RecordBatch], column: int = 1, most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``tables`` in pieces whose texts have about ``most`` bytes (one text at least)."""
    for table in tables:
        for start, end in text_slices(table.column(column), most):
            yield table.slice(start, end - start)


def text_slices(texts: pa.Array, most: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes."""
    sizes = np.asarray(pa.compute.binary_length(texts.fill_null("")))
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - 1) // most
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from zip([0, *ends[:-1]], ends, strict=True)
