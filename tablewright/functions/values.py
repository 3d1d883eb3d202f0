"""Text forms, number readings and strict casts.

Spark and the embedded SQL engines that analysts compare with differ in small ways: how a double
prints, what text counts as a number, how halves round.  All of that is settled here, so the
operators themselves stay plain.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import col, dtype, quoted, sql_text

# Texts up to this length are shuffled as they are; longer ones travel as a digest.
_LONG_TEXT = 64

# Fixed value: the texts that read as a number.
_NUMBER = (
    r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"
)

# The types a cleaning cast may name, with the Spark type each one becomes.
CAST_TYPES = {
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
}


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


# The forms below are Spark SQL text over one operand, itself SQL text such as a quoted column name.
# One parsed expression costs one call into the JVM, where the same built from Column objects would
# cost dozens; on wide tables that is the difference between seconds and minutes of planning.


# --- text ---------------------------------------------------------------------------------


def text_sql(x: str, data_type: T.DataType) -> str:
    """``x`` as text.

    Doubles print in plain notation from 1e-4 up to 1e16 and as ``1e+16`` / ``1.5e-05`` outside,
    instead of Spark's ``1.0E7``.  Lists of numbers print as ``[1, 2]``, other nested values as JSON.
    """
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return _number_text(x)
    if isinstance(data_type, T.ArrayType) and _is_plain(data_type.elementType):
        item = text_sql("item", data_type.elementType)
        return f"concat('[', array_join(transform({x}, item -> {item}), ', ', 'NULL'), ']')"
    if is_nested(data_type):
        return _json(x)
    if isinstance(data_type, T.BinaryType):
        return f"hex({x})"
    return f"cast({x} as string)"


def _is_plain(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType, T.DateType))


def _json(x: str) -> str:
    return f"to_json({x}, map('ignoreNullFields', 'false'))"


def as_text(df: DataFrame, name: str) -> Column:
    return F.expr(text_sql(quoted(name), dtype(df, name)))


def _number_text(x: str) -> str:
    java = f"cast({x} as string)"
    plain = f"rtrim('0', cast(cast({java} as decimal(38,21)) as string))"
    digits = f"substring_index({java}, 'E', 1)"
    mantissa = f"if(endswith({digits}, '.0'), substring_index({digits}, '.', 1), {digits})"
    exponent = f"cast(substring_index({java}, 'E', -1) as int)"
    return f"""case
        when {x} is null or (abs({x}) >= 1e-3 and abs({x}) < 1e7) or {x} = 0 then {java}
        when isnan({x}) then 'nan'
        when abs({x}) = double('Infinity') then if({x} > 0, 'inf', '-inf')
        when abs({x}) >= 1e-4 and abs({x}) < 1e16
          then concat({plain}, if(endswith({plain}, '.'), '0', ''))
        else concat({mantissa}, 'e', if({exponent} < 0, '-', '+'),
                    if(abs({exponent}) < 10, '0', ''), cast(abs({exponent}) as string))
        end"""


def key_sql(x: str, data_type: T.DataType) -> str:
    """An equality-preserving, bounded-size stand-in for grouping on a column.

    Long texts and nested values become a SHA-256 digest, so counting distinct pages or documents
    moves 65 bytes a row through the shuffle and not the text.  A digest is longer than any text
    kept as it is, so the two kinds cannot meet.
    """
    if isinstance(data_type, T.MapType):
        return f"sha2({_json(f'array_sort(map_entries({x}))')}, 256)"
    if is_nested(data_type):
        return f"sha2({_json(x)}, 256)"
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        short = f"hex({x})" if isinstance(data_type, T.BinaryType) else x
        return f"if(length({x}) > {_LONG_TEXT}, concat('#', sha2({x}, 256)), {short})"
    return x


def shuffle_key(df: DataFrame, name: str) -> Column:
    return F.expr(key_sql(quoted(name), dtype(df, name)))


# --- numbers ------------------------------------------------------------------------------


def double_sql(x: str, data_type: T.DataType) -> str:
    """``x`` read as a double, NULL where it is not a number.

    Dates, timestamps and nested values are never numbers, and text such as ``5d`` or ``0x1p3``,
    which Java would take, is not one either.
    """
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return f"cast({x} as double)"
    if isinstance(data_type, T.StringType):
        # Testing the form first also spares the exception that every failing cast costs inside.
        return f"if({x} rlike r'{_NUMBER}', try_cast({x} as double), null)"
    return "cast(null as double)"


def as_double(df: DataFrame, name: str) -> Column:
    return F.expr(double_sql(quoted(name), dtype(df, name)))


# --- strict casts -------------------------------------------------------------------------


def strict_cast(df: DataFrame, name: str, target: str) -> Column:
    """Cast that fails the query on a value it cannot convert."""
    kind = target.upper()
    if kind not in CAST_TYPES:
        raise RequestError(f"unsupported cast type: {target}", code="bad_cast")
    x, data_type = quoted(name), dtype(df, name)
    if kind == "VARCHAR":
        return F.expr(text_sql(x, data_type))
    attempt = try_sql(x, data_type, kind)
    return F.expr(
        f"""case when {x} is not null and ({attempt}) is null
              then raise_error(concat('cannot convert \\'', cast({x} as string), '\\' to {kind}'))
              else {attempt} end"""
    )


def try_sql(x: str, data_type: T.DataType, kind: str) -> str:
    """``x`` as one of the cast types, NULL where its value has no such form."""
    text = isinstance(data_type, T.StringType)
    moment = isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))
    number = isinstance(data_type, (T.NumericType, T.BooleanType))
    if kind == "BIGINT" and isinstance(data_type, (T.DoubleType, T.FloatType)):
        # Halves go to the even neighbour.
        return f"try_cast(rint({x}) as bigint)"
    if kind == "BIGINT" and isinstance(data_type, T.DecimalType):
        return f"try_cast(round({x}, 0) as bigint)"
    if kind == "BIGINT" and text:
        # Text with a point or an exponent is read exactly; halves go away from zero.
        return f"""coalesce(try_cast({x} as bigint),
                            try_cast(round(try_cast({x} as decimal(38,18)), 0) as bigint))"""
    if kind == "DOUBLE" and (number or text):
        return double_sql(x, data_type)
    if kind == "BOOLEAN" and text:
        return f"try_cast({x} as boolean)"
    if kind in {"BIGINT", "BOOLEAN"} and number:
        return f"cast({x} as {CAST_TYPES[kind]})"
    if kind == "TIMESTAMP" and text:
        return f"try_cast({_iso_day(x)} as timestamp_ntz)"
    if kind == "DATE" and text:
        # A time part must be a real time, even though only the day is kept.
        return f"""if(try_cast({_iso_day(x)} as timestamp_ntz) is null, null,
                      try_cast({_iso_day(x)} as date))"""
    if kind in {"TIMESTAMP", "DATE"} and moment:
        return f"cast({x} as {CAST_TYPES[kind]})"
    raise RequestError(f"cannot cast {data_type.simpleString()} to {kind}", code="bad_cast")


def _iso_day(x: str) -> str:
    """Text with slashes turned to dashes; years and months on their own are no dates."""
    dashed = (
        rf"regexp_replace(trim({x}), r'^(\d{{1,4}})/(\d{{1,2}})/(\d{{1,2}})', '$1-$2-$3')"
    )
    return rf"if({dashed} rlike r'^\d+(-\d{{1,2}})?$', null, {dashed})"


# --- literals -----------------------------------------------------------------------------


def literal_text(value: Any) -> str | None:
    """How a literal reads as text."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def typed_literal(value: Any, data_type: T.DataType) -> Column:
    """``value`` as a constant of the column's type, or an error when it has no such form.

    Keeping the constant in the column's own type is what lets Parquet filters be pushed down.
    A fractional number against an integer column stays a double; Spark widens the column.
    """
    if value is None:
        return F.lit(None).cast(data_type)
    try:
        return _typed_literal(value, data_type)
    except (ValueError, OverflowError) as exc:
        raise RequestError(
            f"{value!r} is not a {data_type.simpleString()} value", code="bad_literal"
        ) from exc


def exact_literal(value: Any, data_type: T.DataType) -> Column:
    """``value`` as a constant of exactly the column's type, or an error when it would change."""
    if isinstance(data_type, (T.IntegralType, T.DecimalType)) and value is not None:
        try:
            number = decimal.Decimal(str(int(value) if isinstance(value, bool) else value).strip())
            scale = data_type.scale if isinstance(data_type, T.DecimalType) else 0
            whole = number.scaleb(scale)
            bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}.get(data_type.simpleString())
            limit = 2 ** (bits - 1) if bits else 10**data_type.precision
            if whole != whole.to_integral_value() or not -limit <= whole < limit:
                raise ValueError(value)
        except (ValueError, ArithmeticError) as exc:
            raise RequestError(
                f"{value!r} is not a {data_type.simpleString()} value", code="bad_literal"
            ) from exc
        text = f"{number:f}" if isinstance(data_type, T.DecimalType) else str(int(number))
        return F.lit(text).cast(data_type)
    return typed_literal(value, data_type).cast(data_type)


def _typed_literal(value: Any, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return F.lit(literal_text(value))
    if isinstance(data_type, T.BooleanType):
        if isinstance(value, str):
            lowered = value.strip().lower()
            if lowered not in {"true", "false", "t", "f", "1", "0", "yes", "no", "y", "n"}:
                raise ValueError(value)
            return F.lit(lowered in {"true", "t", "1", "yes", "y"})
        return F.lit(bool(value))
    if isinstance(data_type, T.NumericType):
        number = _number(value)
        if isinstance(number, int) and isinstance(data_type, T.IntegralType):
            narrow = -(2**31) <= number < 2**31 and not isinstance(data_type, T.LongType)
            return F.lit(number).cast("int" if narrow else "bigint")
        return F.lit(float(number)).cast("double")
    if isinstance(data_type, T.DateType):
        return F.lit(dt.date.fromisoformat(str(value).strip()[:10]))
    if isinstance(data_type, (T.TimestampNTZType, T.TimestampType)):
        moment = dt.datetime.fromisoformat(str(value).strip())
        return F.lit(moment.isoformat(sep=" ")).cast(data_type)
    raise ValueError(value)


def _number(value: Any) -> int | float:
    if isinstance(value, (bool, int)):
        return int(value)
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+\s*", value):
        return int(value)
    number = float(value)
    return int(number) if number.is_integer() and abs(number) < 2**53 else number


# --- predicates ---------------------------------------------------------------------------


def like(c: Column, pattern: str) -> Column:
    """LIKE in which ``%`` and ``_`` are live and a backslash is an ordinary character."""
    return c.like(pattern.replace("\\", "\\\\"))


def text_equals(df: DataFrame, name: str, value: Any) -> Column:
    """Whether the text form of a column is ``value``.

    Where the type allows it the test is made on the typed column, which Parquet can answer from
    its statistics: integers print in one way only, so a text that is not that way never matches.
    """
    c, data_type = col(df, name), dtype(df, name)
    text = literal_text(value)
    if text is None:
        return F.lit(None).cast("boolean")
    never = F.when(c.isNotNull(), False)
    if isinstance(data_type, T.IntegralType):
        plain = re.fullmatch(r"0|-?[1-9]\d{0,18}", text)
        if plain and -(2**63) <= int(text) < 2**63:
            return c == typed_literal(int(text), data_type)
        return never
    if isinstance(data_type, T.BooleanType):
        return c == F.lit(text == "true") if text in {"true", "false"} else never
    if isinstance(data_type, T.DateType):
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            try:
                return c == F.lit(dt.date.fromisoformat(text))
            except ValueError:
                return never
        return as_text(df, name) == text
    if isinstance(data_type, T.TimestampNTZType):
        if re.fullmatch(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", text):
            try:
                dt.datetime.fromisoformat(text)
            except ValueError:
                return never
            return c == F.lit(text).cast("timestamp_ntz")
    if isinstance(data_type, (T.DoubleType, T.DecimalType)):
        # A text that prints like the column also reads back as its number, and that test reaches
        # the files; the text itself still decides.
        try:
            finite = math.isfinite(float(text))
        except ValueError:
            return never
        if finite:
            number = F.lit(float(text)) if isinstance(data_type, T.DoubleType) else F.expr(
                f"try_cast({sql_text(text)} as {data_type.simpleString()})"
            )
            return (c == number) & (as_text(df, name) == text)
    return as_text(df, name) == text
