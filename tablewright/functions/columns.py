"""Looking up columns and naming their types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError

# Name of the hidden column in stored tables that remembers the order of arrival.
ORDINAL = "_ordinal"

# The eight logical types a column can have.
INTEGER = "integer"
FLOAT = "float"
BOOLEAN = "boolean"
DATETIME = "datetime"
CATEGORICAL = "categorical"
TEXT = "text"
BINARY = "binary"
UNKNOWN = "unknown"


def quoted(name: str) -> str:
    """``name`` as one identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """``value`` as a SQL string constant."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``; dots are part of the name, not a path."""
    require(df, [name])
    return F.col(quoted(name))


def unused_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` is called so (case aside)."""
    taken = {n.lower() for n in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def require(df: DataFrame, names: Sequence[str]) -> None:
    """Raise when ``df`` lacks one of ``names``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise RequestError(f"unknown column: {', '.join(missing)}", code="unknown_column")


def dtype(df: DataFrame, name: str) -> T.DataType:
    """The Spark type of a column."""
    require(df, [name])
    return next(f.dataType for f in df.schema.fields if f.name == name)


def visible(df: DataFrame) -> list[str]:
    """The user's columns, without the hidden ordinal."""
    return [n for n in df.columns if n != ORDINAL]


def select_all(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def logical_type(data_type: T.DataType) -> str:
    """The logical type of a physical Spark type (decimals count as float)."""
    if isinstance(data_type, T.IntegralType):
        return INTEGER
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, T.BinaryType):
        return BINARY
    if isinstance(data_type, T.StringType):
        return TEXT
    return UNKNOWN


def spark_type(logical: str) -> T.DataType:
    """The Spark type used to store a logical type."""
    return {
        INTEGER: T.LongType(),
        FLOAT: T.DoubleType(),
        BOOLEAN: T.BooleanType(),
        DATETIME: T.TimestampNTZType(),
        BINARY: T.BinaryType(),
    }.get(logical, T.StringType())


def field_logical_type(field: T.StructField) -> str:
    """Logical type of a field; an override in its metadata wins."""
    override = (field.metadata or {}).get("logical_type")
    if override and (field.metadata or {}).get("override"):
        return override
    return logical_type(field.dataType)


def with_logical_type(df: DataFrame, name: str, logical: str) -> DataFrame:
    """Override the logical type of one column without touching its data."""
    require(df, [name])
    return df.withMetadata(name, {"logical_type": logical, "override": True})
