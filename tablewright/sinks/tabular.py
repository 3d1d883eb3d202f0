"""Writing tables out as directories of CSV or JSON-lines files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import values as v
from tablewright.functions.columns import dtype, quoted, select_all, visible
from tablewright.operators.paging import first_rows



def capped(df: DataFrame, cap: int | None = None) -> DataFrame:
    """The visible columns of all rows, or of the first ``cap`` of them when a cap is asked for.

    A capped export is written by as many tasks as hold its rows.
    """
    rows = df.select(*select_all(visible(df)))
    return rows if cap is None else first_rows(rows, cap)


def export_summary(
    df: DataFrame, cap: int | None = None, exact_truncation: bool = False
) -> DataFrame:
    """One row: ``row_count`` of the export and whether it is ``truncated``.

    A table that just fills the cap counts as truncated, unless ``exact_truncation`` is asked for.
    The count comes from file footers where the table is made of files.
    """
    seen = F.count(F.lit(1))
    if cap is None:
        return df.agg(seen.alias("row_count"), F.lit(False).alias("truncated"))
    return df.agg(
        F.least(seen, F.lit(cap)).cast("bigint").alias("row_count"),
        (seen > cap if exact_truncation else seen >= cap).alias("truncated"),
    )


def write_csv(df: DataFrame, path: str, cap: int | None = None) -> None:
    """UTF-8 CSV with a header in every part; numbers and nested values in their text form.

    White space at the ends of cells stays.  Cells with line breaks are quoted; such files are read
    back with ``multiline``.
    """
    rows = capped(df, cap)
    texts = [v.as_text(rows, n).alias(n) for n in rows.columns]
    rows.select(*texts).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json(df: DataFrame, path: str, cap: int | None = None) -> None:
    """JSON lines; values JSON has no form for, such as timestamps, are written as text."""
    rows = capped(df, cap)
    rows.select(*[_json_value(rows, n) for n in rows.columns]).write.option(
        "ignoreNullFields", False
    ).json(path)


def _json_value(df: DataFrame, name: str) -> Column:
    kind = dtype(df, name).typeName()
    if kind in {"date", "timestamp", "timestamp_ntz", "decimal", "binary"}:
        return v.as_text(df, name).alias(name)
    return F.col(quoted(name))
