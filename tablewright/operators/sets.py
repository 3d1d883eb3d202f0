"""Set operations that count repeated rows, and what changed between two revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import quoted, select_all, visible

#: Copies of a row that are made at once.
COPIES = 10_000


def comparable(df: DataFrame, names: list[str]) -> bool:
    """Whether ``row_digest`` takes these columns."""
    return not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields if f.name in names)


def row_digest(df: DataFrame, names: list[str]) -> Column:
    """SHA-256 of a row's values; equal values, nulls among them, have equal digests."""

    def part(name: str) -> Column:
        kind = next(f.dataType for f in df.schema.fields if f.name == name)
        value = F.col(quoted(name))
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            text = (value + F.lit(0.0).cast(kind)).cast("string")  # one zero, whatever its sign
        elif isinstance(kind, T.BinaryType):
            text = F.base64(value)
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            text = F.to_json(value, {"ignoreNullFields": "false"})
        elif isinstance(kind, (T.MapType, T.VariantType)):
            raise RequestError(f"rows with '{name}' cannot be compared", code="not_comparable")
        else:
            text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(n) for n in names]).cast("binary"), 256)


def _counted(left: DataFrame, right: DataFrame) -> tuple[DataFrame, list[str]]:
    """``digest``, one row of each kind, and how often ``left`` (``n``) and ``right`` (``m``) have it.

    The digest is the key, so long texts are compared once, by 64 digits; repeated rows are put
    together within the task first, so that copies of one row do not meet in one task.
    """
    names = visible(left)
    if [f.dataType for f in left.select(*select_all(names)).schema] != [f.dataType for f in right.select(*select_all(visible(right))).schema]:
        raise RequestError("the two tables have different columns", code="different_columns")
    right = right.select(*[F.col(quoted(b)).alias(a) for a, b in zip(names, visible(right), strict=True)])
    row = F.struct(*[F.col(quoted(n)) for n in names])
    signed = [
        df.select(row_digest(df, names).alias("digest"), row.alias("row"), F.lit(n).alias("n"), F.lit(m).alias("m"))
        for df, n, m in ((left, 1, 0), (right, 0, 1))
    ]
    both = signed[0].unionAll(signed[1])
    return both.groupBy("digest").agg(F.first("row").alias("row"), F.sum("n").alias("n"), F.sum("m").alias("m")), names


def _repeated(rows: DataFrame, times: Column, names: list[str]) -> DataFrame:
    """Each row as often as ``times`` says, in runs of at most COPIES."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(COPIES).cast("long")))
    rows = rows.withColumn("times", times).filter("times > 0").select("row", "times", runs.alias("start"))
    length = F.least(F.col("times") - F.col("start"), F.lit(COPIES)).cast("int")
    copies = rows.select("row", F.explode(F.array_repeat(F.lit(0), length)))
    return copies.select(*[F.col(f"row.{quoted(n)}").alias(n) for n in names])


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both tables, each as often as the one has it that has it less often."""
    rows, names = _counted(left, right)
    return _repeated(rows, F.least("n", "m"), names)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left``, each as often as ``left`` has it more often than ``right``."""
    rows, names = _counted(left, right)
    return _repeated(rows, F.col("n") - F.col("m"), names)


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a revision changed: ``change`` (``added`` or ``removed``), ``copies`` and the row's columns."""
    rows, names = _counted(before, after)
    rows = rows.filter("n <> m")
    return rows.select(
        F.when(F.col("m") > F.col("n"), "added").otherwise("removed").alias("change"),
        F.abs(F.col("m") - F.col("n")).alias("copies"),
        *[F.col(f"row.{quoted(n)}").alias(n) for n in names],
    )
