"""Columnar tables in folders by column value, as Parquet or ORC.

Partition columns come from the folders' names and prune whole folders, at planning time by
constants and at run time by the values a join brings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import ORDINAL, quoted, require

#: The columnar formats.
FORMATS = ("parquet", "orc")


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], *, form: str = "parquet", append: bool = False
) -> None:
    """Write a table into folders named after the values of ``by``.

    Spark evens out the tasks by size: a folder with a third of all rows is many files, and small
    folders share a task, so there are not as many files as tasks times folders.  ``append`` adds files;
    otherwise the folder must be new.
    """
    _known(form)
    require(df, by)
    rest = [n for n in df.columns if n not in by and n != ORDINAL]
    if not by or not rest:
        raise RequestError("a partitioned table needs columns of both kinds", code="no_columns")
    rows = df.drop(ORDINAL).hint("rebalance", *[F.col(quoted(n)) for n in by])
    rows.write.partitionBy(*by).format(form).mode("append" if append else "errorifexists").save(path)


def read_partitioned(
    spark: SparkSession,
    path: str,
    *,
    form: str = "parquet",
    partitions: str = "",
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Read such a table; columns are matched by name and files that lack one have NULL there.

    ``partitions`` (DDL) gives the types of the partition columns, which are else guessed from all
    folder names together.  Without ``schema`` the columns are the union of those of all files, whose types must then
    agree; with it, that of the table's own columns is as stated, no file is opened to plan the
    read, and Parquet files with a narrower number type are widened.
    """
    _known(form)
    reader = spark.read.format(form)
    typed = T.StructType.fromDDL(partitions) if partitions else T.StructType()
    if schema is None:
        own = reader.option("mergeSchema", True).load(path).schema
    else:
        own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.format(form).schema(_with(own, typed)).load(path)


def _with(own: T.StructType, typed: T.StructType) -> T.StructType:
    names = set(typed.names)
    return T.StructType([*[f for f in own.fields if f.name not in names], *typed.fields])


def _known(form: str) -> None:
    if form not in FORMATS:
        raise RequestError(f"no columnar format: {form}", code="unknown_format")
