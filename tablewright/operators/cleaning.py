"""Cleaning steps: each one turns a DataFrame and its parameters into a DataFrame.

All steps are plain projections, filters or one keyed grouping, so a whole pipeline collapses into
a single Catalyst plan.  A rewritten column moves to the end of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions import values as v
from tablewright.functions.columns import (
    ORDINAL,
    col,
    dtype,
    require,
    select_all,
    unused_name,
    visible,
)
from tablewright.operators.sets import comparable, row_digest

Params = Mapping[str, Any]


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove columns; an empty list changes nothing."""
    require(df, columns)
    gone = set(columns)
    return df.select(*select_all([n for n in df.columns if n not in gone])) if gone else df


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a column and move it to the end."""
    return _rewritten(df, old, col(df, old), new)


def cast_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Convert a column to BIGINT, DOUBLE, BOOLEAN, VARCHAR, TIMESTAMP or DATE.

    A value that cannot be converted fails the query; nothing turns silently into NULL.
    """
    return _rewritten(df, column, v.strict_cast(df, column, target))


def fill_null(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Replace NULL by a constant, which must have a form in the column's own type."""
    literal = v.exact_literal(value, dtype(df, column))
    return _rewritten(df, column, F.coalesce(col(df, column), literal))


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the rows in which none of the columns is NULL (NaN is a value)."""
    if not columns:
        raise RequestError("drop_nulls needs at least one column", code="no_columns")
    for name in columns:
        df = df.filter(col(df, name).isNotNull())
    return df


def trim_column(df: DataFrame, column: str) -> DataFrame:
    """Turn a column into text without leading and trailing spaces."""
    return _rewritten(df, column, F.trim(v.as_text(df, column)))


def replace_values(df: DataFrame, column: str, old: Any, new: Any) -> DataFrame:
    """Replace one value by another, which must have a form in the column's own type.

    NULL equals nothing, so ``old=None`` never matches, and neither does a value that the type has
    no form for.
    """
    data_type = dtype(df, column)
    replacement = v.exact_literal(new, data_type)
    try:
        matches = col(df, column) == v.exact_literal(old, data_type)
    except RequestError:
        matches = F.lit(False)
    return _rewritten(df, column, F.when(matches, replacement).otherwise(col(df, column)))


def dedupe(
    df: DataFrame, columns: Sequence[str] = (), order_by: Sequence[str] | None = None
) -> DataFrame:
    """Keep one row for each combination of ``columns``, the first by ``order_by``.

    Stored tables order by arrival.  With no order at all any row of the group may stay.  Every
    task keeps only its own best row per key before the shuffle, so a key that holds a large part
    of the table sends no more than one row per task.  Without columns, whole rows are compared.
    """
    if order_by is None and ORDINAL in df.columns:
        order_by = [ORDINAL]
    if not columns and not order_by:
        return df.distinct()
    keys = list(columns) or visible(df)
    require(df, keys)
    if not columns and list(order_by) == [ORDINAL] and comparable(df, keys):
        # Rows are told apart by their digests, and each task sends the first of each kind only.
        row = F.struct(*select_all(df.columns))
        firsts = df.groupBy(row_digest(df, keys).alias("digest")).agg(F.min_by(row, ORDINAL).alias("row"))
        return firsts.select(*[F.col("row").getField(n).alias(n) for n in df.columns])
    if not order_by:
        return df.dropDuplicates(keys)
    first = Window.partitionBy(*select_all(keys)).orderBy(
        *[col(df, name).asc_nulls_last() for name in order_by]
    )
    rank = unused_name(df, "rank")
    return df.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(rank)


# The comparison signs a row filter accepts.
COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def filter_rows(df: DataFrame, column: str, operator: str, value: Any) -> DataFrame:
    """Keep the rows whose column compares as asked with a constant; NULL keeps nothing."""
    if operator == "LIKE":
        if value is None:
            return df.filter(F.lit(False))
        return df.filter(v.like(v.as_text(df, column), v.literal_text(value)))
    if operator not in COMPARISONS:
        raise RequestError(f"unknown filter operator: {operator}", code="filter_sign")
    literal = v.typed_literal(value, dtype(df, column))
    return df.filter(COMPARISONS[operator](col(df, column), literal))


def _rewritten(df: DataFrame, old: str, value: Column, new: str | None = None) -> DataFrame:
    new = new or old
    others = [n for n in df.columns if n != old]
    if new in others:
        raise RequestError(f"column already exists: {new}", code="duplicate_column")
    return df.select(*select_all(others), value.alias(new))


# --- registry -----------------------------------------------------------------------------


@dataclass(frozen=True)
class StepKind:
    """What a pipeline needs to know of a step: how to check it and how to apply it."""

    apply: Callable[[DataFrame, Params], DataFrame]
    validate: Callable[[Params], None] = lambda params: None


def _needs(*names: str) -> Callable[[Params], None]:
    """A check that parameters are there; what they hold is checked where they are used."""

    def check(params: Params) -> None:
        missing = [n for n in names if params.get(n) is None]
        if missing:
            raise RequestError(f"missing parameter: {', '.join(missing)}", code="no_parameter")

    return check


def _names(params: Params) -> list[str]:
    return [str(n) for n in params.get("columns") or []]


# The names of the stored steps and of their parameters.
_BUILT_IN: dict[str, StepKind] = {
    "drop_columns": StepKind(lambda df, p: drop_columns(df, _names(p))),
    "rename_column": StepKind(
        lambda df, p: rename_column(df, str(p["from"]), str(p["to"])), _needs("from", "to")
    ),
    "cast_column": StepKind(
        lambda df, p: cast_column(df, str(p["column"]), str(p["duck_type"])),
        _needs("column", "duck_type"),
    ),
    "fill_null": StepKind(
        lambda df, p: fill_null(df, str(p["column"]), p.get("value")), _needs("column")
    ),
    "drop_nulls": StepKind(lambda df, p: drop_nulls(df, _names(p))),
    "trim_column": StepKind(lambda df, p: trim_column(df, str(p["column"])), _needs("column")),
    "replace_values": StepKind(
        lambda df, p: replace_values(df, str(p["column"]), p.get("old"), p.get("new")),
        _needs("column"),
    ),
    "dedupe": StepKind(lambda df, p: dedupe(df, _names(p), p.get("order_by"))),
    "filter_rows": StepKind(
        lambda df, p: filter_rows(
            df, str(p["column"]), str(p.get("operator", "=")), p.get("value")
        ),
        _needs("column"),
    ),
}
_CUSTOM: dict[str, StepKind] = {}


def register_step(
    name: str,
    apply: Callable[[DataFrame, Params], DataFrame],
    validate: Callable[[Params], None] = lambda params: None,
) -> None:
    """Add a step of one's own, usable in pipelines under ``name``."""
    if name in _BUILT_IN:
        raise RequestError(f"{name} is a built-in step", code="duplicate_step")
    _CUSTOM[name] = StepKind(apply, validate)


def step_kind(name: str) -> StepKind:
    kind = _BUILT_IN.get(name) or _CUSTOM.get(name)
    if kind is None:
        raise RequestError(f"unknown cleaning step: {name}", code="no_such_step")
    return kind
