"""JSON files: unwrapping the record list and flattening nested objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import quoted
from tablewright.workspace import new_folder

# The fields of a root object that may hold its list of records, in order.
WRAPPERS = ("data", "records", "items", "rows")


def read_json(
    spark: SparkSession, path: str, *, lines: bool = False, flatten: bool = True
) -> DataFrame:
    """Read JSON files as records.

    Every file is looked at for itself.  A root array gives one row per item; a root object gives
    one row, unless one of ``data``, ``records``, ``items`` or ``rows`` holds an array, whose items
    are its rows then.  Items that are no objects become the column ``value``.  Columns are the
    union of all records' keys in alphabetical order.  What is no JSON fails the query.

    A file holding one JSON value cannot be split, so it is one task, which writes its records as
    lines to the shared folder; with ``lines`` files hold one record per line and split like any
    text, which is the form to use for large inputs.
    """
    source = path if lines else _record_lines(spark, path)
    records = spark.read.option("mode", "FAILFAST").json(source)
    return flattened(records) if flatten else records


def _record_lines(spark: SparkSession, path: str) -> str:
    """The records of all files, one a line, in a new folder."""
    # parse_json tells what a file is; whatever it holds below its root stays as it is.
    root = spark.read.text(path, wholetext=True).select(F.trim("value").alias("text"))
    root = root.select("text", F.parse_json("text").alias("root"))
    items = F.when(F.col("text").startswith("["), F.expr("cast(root as array<variant>)"))
    for name in WRAPPERS:
        inner = F.try_variant_get("root", f"$.{name}", "array<variant>")
        wrapped = F.col("text").startswith("{") & inner.isNotNull()
        items = items.when(wrapped, inner)
    plain = F.when(~F.col("text").startswith("{"), F.raise_error(F.lit("a JSON root must be an array or an object")))
    items = items.otherwise(F.array(F.coalesce(plain.cast("variant"), F.col("root"))))
    item = F.to_json(F.col("item"))
    record = F.when(item.startswith("{"), item).otherwise(
        F.concat(F.lit('{"value":'), F.coalesce(item, F.lit("null")), F.lit("}"))
    )
    folder = new_folder(spark, "json-lines")
    root.select(F.explode(items).alias("item")).select(record.alias("value")).write.text(folder)
    return folder


def flattened(df: DataFrame) -> DataFrame:
    """Nested objects become columns named ``a.b.c``; lists stay lists."""
    return df.select(*_leaves(df.schema, ()))


def _leaves(schema: T.StructType, above: tuple[str, ...]) -> list[Column]:
    leaves: list[Column] = []
    for field in schema.fields:
        path = (*above, field.name)
        if isinstance(field.dataType, T.StructType):
            leaves += _leaves(field.dataType, path)
        else:
            leaves.append(F.col(".".join(quoted(p) for p in path)).alias(".".join(path)))
    return leaves
