"""Delimited text files: delimiter detection, typed reading, preview."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions import values as v
from tablewright.sources.headers import normalised_names

PREVIEW_ROWS = 200

# File suffixes, and the cell texts that mean NULL, in text columns as well as in
# numeric ones.
SUFFIXES = (".csv", ".tsv", ".txt")
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)


def detect_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file``, the ``delimiter`` its text speaks for, and its first line.

    A tab if there are more tabs than commas, else a semicolon if there are more semicolons than
    commas, else a comma.  Files are read as splittable lines and counted where they are; one row
    per file and task is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.monotonically_increasing_id().alias("at"),
    )

    def count(sign: str) -> Column:
        length, without = F.length("value"), F.length(F.replace(F.col("value"), F.lit(sign)))
        return F.sum(length - without).alias(sign)

    first = F.when((F.col("block") == 0) & (F.trim("value") != ""), F.struct("at", "value"))
    counts = lines.groupBy("file").agg(count("\t"), count(","), count(";"), F.min(first).alias("first"))
    return counts.select(
        "file",
        F.when(F.col("\t") > F.col(","), "\t")
        .when(F.col(";") > F.col(","), ";")
        .otherwise(",")
        .alias("delimiter"),
        F.col("first.value").alias("header"),
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    delimiter: str | None = None,
    schema: T.StructType | str | None = None,
    normalise_header: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Read files with a header row into typed columns.

    Files may differ in their delimiters and in the order of their columns, which are matched by
    name; the file whose name sorts first gives the order.  Files that lack columns or have others
    are refused.

    Without a ``schema`` one aggregation over the files finds, for each column, the narrowest of
    integer, boolean, date, timestamp and float that all of its cells have; large inputs should come
    with a schema, which saves that pass.  A cell that does not fit its column fails the query.

    Cells with line breaks in quotes need ``multiline``, since a file that may have them can be read only from
    its start: each file is one task, so let there be many.  Without it such cells make lines of the
    wrong width, which fail the query.  Headers have no line breaks.
    """
    groups = _header_groups(spark, path, delimiter)
    if not groups:
        return spark.createDataFrame([], T.StructType([]))
    names: list[str] = []
    cleaned: DataFrame | None = None
    for sep, header, _ in groups:
        cells = [x or None for x in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))]
        own = normalised_names(cells) if normalise_header else [str(x) for x in cells]
        names = names or own
        if sorted(own) != sorted(names):
            raise RequestError(f"files with different columns: {names} and {own}", code="headers_differ")
        where = path if len(groups) == 1 else _files(spark, path, delimiter, sep, header)
        rows = _cells(spark, where, sep, len(own), multiline)
        rows = rows.select(*[F.col(f"_c{own.index(n)}").alias(f"_c{i}") for i, n in enumerate(names)])
        cleaned = rows if cleaned is None else cleaned.unionByName(rows)
    columns = cleaned.columns
    if schema is None:
        targets = _found_types(cleaned)
    else:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names = [f.name for f in wanted.fields]
        targets = [f.dataType.simpleString() for f in wanted.fields]
    return cleaned.select(
        *[_converted(c, target).alias(name) for c, name, target in zip(columns, names, targets, strict=True)]
    )


def _described(spark: SparkSession, path: str, delimiter: str | None) -> DataFrame:
    found = detect_delimiters(spark, path).filter(F.col("header").isNotNull())
    return found if delimiter is None else found.withColumn("delimiter", F.lit(delimiter))


def _header_groups(spark: SparkSession, path: str, delimiter: str | None) -> list[tuple[str, str, str]]:
    """``(delimiter, header line, first file)`` of the kinds of files there are, by first file."""
    kinds = _described(spark, path, delimiter).groupBy("delimiter", "header").agg(F.min("file").alias("file"))
    return [tuple(r) for r in kinds.orderBy("file").collect()]


def _files(spark: SparkSession, path: str, delimiter: str | None, sep: str, header: str) -> list[str]:
    """The names of the files of one kind, of which the driver makes its list of splits anyway."""
    own = _described(spark, path, delimiter).filter((F.col("delimiter") == sep) & (F.col("header") == header))
    return [r["file"] for r in own.select("file").orderBy("file").collect()]


def _cells(spark: SparkSession, path: str | list[str], sep: str, width: int, multiline: bool = False) -> DataFrame:
    """The cells of files as text, NULL where they say so."""
    raw = (
        spark.read.option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("multiLine", multiline)
        .schema(T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)]))
    )
    # Else Spark guesses what ends a line from the text, and changes those within cells.
    raw = (raw.option("lineSep", "\n") if multiline else raw).csv(path)
    tokens = list(NULL_TOKENS)
    return raw.select(*[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) for c in raw.columns])


# The words of truth columns, and what integers and points in time look like.
_TRUTH = ("true", "True", "TRUE", "false", "False", "FALSE")
_INTEGER = r"^[ \t]*-?\d+[ \t]*$"
_MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"

# The kinds of cells, one bit each, and the column types with the kinds each of them can hold, the
# narrowest first.  Every cell is of the first kind it meets, so most cells take a single test.
_BIT, _WHOLE, _WORD, _DAY, _TIME, _REAL, _OTHER = (1 << i for i in range(7))
_COLUMN_TYPES = {
    "bigint": _BIT | _WHOLE,
    "boolean": _BIT | _WORD,
    "date": _DAY,
    "timestamp_ntz": _DAY | _TIME,
    "double": _BIT | _WHOLE | _REAL,
}


def _kind(x: str) -> str:
    """The kind of a cell; NULL for NULL, which fits every type."""
    words = ", ".join(f"'{word}'" for word in _TRUTH)
    dashed = f"substr({x}, 5, 1) = '-' and substr({x}, 8, 1) = '-'"
    return f"""case when {x} is null then null
        when {x} in ('0', '1') then {_BIT}
        when {x} rlike r'{_INTEGER}' and try_cast({x} as bigint) is not null then {_WHOLE}
        when {x} in ({words}) then {_WORD}
        when {dashed} and length({x}) = 10 and try_cast({x} as date) is not null then {_DAY}
        when {dashed} and {x} rlike r'{_MOMENT}' and try_cast({x} as timestamp_ntz) is not null
          then {_TIME}
        when {v.double_sql(x, T.StringType())} is not null then {_REAL}
        else {_OTHER} end"""


def _found_types(df: DataFrame) -> list[str]:
    """The type of each column; one row of kinds per column comes back, never data.

    Cells are unpivoted, so that a single small expression is compiled however wide the file is.
    """
    cells = ", ".join(f"struct({i} as position, {x} as x)" for i, x in enumerate(df.columns))
    found = (
        df.selectExpr(f"inline(array({cells}))")
        .filter("x is not null")
        .groupBy("position")
        .agg(F.expr(f"bit_or({_kind('x')})").alias("kinds"))
        .collect()
    )
    kinds = {row["position"]: row["kinds"] for row in found}
    return [_column_type(kinds.get(i, 0)) for i in range(len(df.columns))]


def _column_type(kinds: int) -> str:
    fitting = (t for t, holds in _COLUMN_TYPES.items() if kinds and not kinds & ~holds)
    return next(fitting, "string")


def _converted(x: str, target: str) -> Column:
    if target == "string":
        return F.col(x)
    value = f"try_cast(trim({x}) as {target})"
    if target in {"double", "float"}:
        value = f"cast({v.double_sql(x, T.StringType())} as {target})"
    return F.expr(
        f"""case when {x} is not null and ({value}) is null
              then cast(raise_error(concat('not a {target}: ', {x})) as {target})
              else {value} end"""
    )


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of any source; only as many partitions are read as that takes."""
    return df.limit(rows)
