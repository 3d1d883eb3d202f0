"""Column statistics.

Each function takes a table and gives one row per column.  A profile reads the table once for the
moments of its numeric columns, once for counts, extremes and outliers, once for sample values, once
for duplicate rows, and once more, column by column, for distinct values.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as v
from tablewright.functions.columns import (
    BOOLEAN,
    CATEGORICAL,
    DATETIME,
    FLOAT,
    INTEGER,
    ORDINAL,
    TEXT,
    UNKNOWN,
    col,
    dtype,
    logical_type,
    quoted,
    require,
    select_all,
    sql_text,
    unused_name,
    visible,
)

# Up to this many columns each is counted by a scan of its own, which reads only its own pages;
# beyond it the table is unpivoted, so that the number of tasks stays that of one scan.  The counts
# are the same.
COLUMNWISE_LIMIT = 48

SAMPLE_VALUES = 5


def is_number(df: DataFrame, name: str) -> bool:
    return logical_type(dtype(df, name)) in {INTEGER, FLOAT}


def _orderable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.MapType, T.VariantType))


# --- counts, extremes and outliers ----------------------------------------------------------


def basic_statistics(df: DataFrame, outliers: bool = True) -> DataFrame:
    """Per column: ``row_count``, ``null_count``, ``min_value``, ``max_value``, ``outlier_count``.

    Extremes are found on typed values and then printed.  An outlier is a number more than three
    sample standard deviations from the mean.  Everything is one aggregation; means and deviations
    enter it as one scalar subquery, which is one row however large the table.
    """
    names = visible(df)
    numeric = [n for n in names if is_number(df, n)] if outliers else []
    moments = unused_name(df, "moments")
    basis = df.withColumn(moments, _moments(df, numeric)) if numeric else df
    aggregates = ["count(1) as rows"]
    rows = []
    for i, name in enumerate(names):
        x, data_type = quoted(name), dtype(df, name)
        ends = [f"{end}({x})" if _orderable(data_type) else "null" for end in ("min", "max")]
        far = "cast(0 as bigint)"
        if name in numeric:
            mean, deviation = f"{moments}.mean{i}", f"{moments}.dev{i}"
            distance = f"abs({v.double_sql(x, data_type)} - {mean})"
            far = f"count_if({deviation} > 0 and {distance} > 3 * {deviation})"
        aggregates += [
            f"count({x}) as present{i}",
            f"{ends[0]} as low{i}",
            f"{ends[1]} as high{i}",
            f"{far} as far{i}",
        ]
        rows.append(
            f"""struct({i} as position, {sql_text(name)} as column_name, rows as row_count,
                       rows - present{i} as null_count, far{i} as outlier_count,
                       {v.text_sql(f"low{i}", data_type)} as min_value,
                       {v.text_sql(f"high{i}", data_type)} as max_value)"""
        )
    wide = basis.agg(*[F.expr(a) for a in aggregates])
    return wide.selectExpr(f"inline(array({', '.join(rows)}))")


def _moments(df: DataFrame, numeric: Sequence[str]) -> Column:
    parts = []
    for i, name in enumerate(visible(df)):
        if name in numeric:
            number = v.double_sql(quoted(name), dtype(df, name))
            parts += [f"avg({number}) as mean{i}", f"stddev_samp({number}) as dev{i}"]
    stats = df.agg(*[F.expr(part) for part in parts])
    return stats.select(F.struct("*").alias("m")).scalar()


def outlier_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: ``column_name`` and ``outlier_count``."""
    chosen = [n for n in (columns or visible(df)) if is_number(df, n)]
    narrow = df.select(*select_all(chosen))
    return basic_statistics(narrow).select("column_name", "outlier_count")


# --- distinct values ------------------------------------------------------------------------


def distinct_counts(
    df: DataFrame, approximate: bool = False, single_pass: bool | None = None
) -> DataFrame:
    """Per column: ``column_name`` and ``distinct_count``, exact unless asked otherwise.

    Exact counts group by value first and count the groups next, so both steps combine before they
    shuffle and a value that fills a third of the table costs one row per task.  Columns are scanned
    one by one, or all in a ``single_pass`` when the table is wide or small.
    """
    names = visible(df)
    if approximate:
        return _approximate_counts(df, names)
    if len(names) > COLUMNWISE_LIMIT if single_pass is None else single_pass:
        return _unpivoted_counts(df, names)
    return reduce(DataFrame.unionByName, [_own_count(df, n) for n in names])


def _own_count(df: DataFrame, name: str) -> DataFrame:
    key = v.shuffle_key(df, name).alias("k")
    return (
        df.select(key)
        .distinct()
        .agg(F.count("k").alias("distinct_count"))
        .select(F.lit(name).alias("column_name"), "distinct_count")
    )


def _unpivoted_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"struct({i} as position, {_typed_cell(df, n)})" for i, n in enumerate(names))
    counted = (
        df.selectExpr(f"inline(array({cells}))")
        .filter("whole is not null or real is not null or text is not null")
        .distinct()
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Columns that are NULL throughout have no cells; the maximum with 0 keeps their row.
    every = df.sparkSession.range(len(names)).select(
        F.col("id").cast("int").alias("position"), F.lit(0).cast("bigint").alias("n")
    )
    return (
        counted.unionByName(every)
        .groupBy("position")
        .agg(F.max("n").alias("distinct_count"))
        .selectExpr(
            f"element_at(array({', '.join(map(sql_text, names))}), position + 1) as column_name",
            "distinct_count",
        )
    )


def _typed_cell(df: DataFrame, name: str) -> str:
    """A value as whole number, real number or text, the other two being NULL."""
    x, data_type = quoted(name), dtype(df, name)
    cell = {"whole": "cast(null as bigint)", "real": "cast(null as double)"}
    cell["text"] = "cast(null as string)"
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        cell["whole"] = f"cast({x} as bigint)"
    elif isinstance(data_type, T.TimestampType):
        # Two instants may print alike when clocks are put back.
        cell["whole"] = f"unix_micros({x})"
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        cell["real"] = f"cast({x} as double)"
    else:
        cell["text"] = f"cast({v.key_sql(x, data_type)} as string)"
    return ", ".join(f"{value} as {label}" for label, value in cell.items())


def _approximate_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    keys = [v.shuffle_key(df, n) for n in names]
    wide = df.agg(*[F.approx_count_distinct(k).alias(f"d{i}") for i, k in enumerate(keys)])
    rows = [
        F.struct(F.lit(n).alias("column_name"), F.col(f"d{i}").alias("distinct_count"))
        for i, n in enumerate(names)
    ]
    return wide.select(F.inline(F.array(*rows)))


# --- sample values and duplicates -------------------------------------------------------------


def sample_values(
    df: DataFrame,
    order_by: str | None = None,
    count: int = SAMPLE_VALUES,
) -> DataFrame:
    """Per column and rank: ``column_name``, ``sample_no``, ``sample_value``.

    These are the first non-NULL values by ``order_by``, or by arrival; rows whose place is NULL
    come last.  The table is read once for all columns, and every task keeps its own ``count`` best
    rows per column before the shuffle.
    """
    names = visible(df)
    if order_by is None and ORDINAL in df.columns:
        order_by = ORDINAL
    # Rows without a place in the order come last.
    place = "monotonically_increasing_id()" if order_by is None else quoted(order_by)
    if order_by is not None:
        require(df, [order_by])
    cells = ", ".join(
        f"struct({i} as column_no, {v.text_sql(quoted(n), dtype(df, n))} as sample_value)"
        for i, n in enumerate(names)
    )
    values = df.selectExpr(f"{place} as place", f"inline(array({cells}))")
    rank = F.row_number().over(
        Window.partitionBy("column_no").orderBy(F.col("place").asc_nulls_last(), "sample_value")
    )
    labels = ", ".join(map(sql_text, names))
    return (
        values.filter("sample_value is not null")
        .withColumn("sample_no", rank)
        .filter(F.col("sample_no") <= count)
        .selectExpr(f"element_at(array({labels}), column_no + 1) as column_name", "sample_no", "sample_value")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row with ``duplicate_count``: the rows beyond the first of each set of equal rows.

    Equal rows are counted together inside each task first.
    """
    keys = [v.shuffle_key(df, n).alias(f"k{i}") for i, n in enumerate(visible(df))]
    return (
        df.select(*keys)
        .groupBy(*[f"k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"))
    )


# --- whole profile ----------------------------------------------------------------------------


def profile_columns(
    df: DataFrame, sampled: bool = False, approximate: bool = False, outliers: bool = True
) -> DataFrame:
    """One row per column with counts, extremes, outliers and whether it could be a key.

    A column is a candidate key when it has no NULL and as many values as there are rows; a sample
    cannot show that.  The parts are a few rows each and meet in one small grouping.
    """
    basic = basic_statistics(df, outliers)
    # A sample is small enough to take all its columns at once.
    distinct = distinct_counts(df, approximate, single_pass=sampled or None)
    merged = (
        basic.unionByName(distinct, allowMissingColumns=True)
        .groupBy("column_name")
        .agg(
            *[
                F.max(n).alias(n)
                for n in (
                    "position",
                    "row_count",
                    "null_count",
                    "distinct_count",
                    "min_value",
                    "max_value",
                    "outlier_count",
                )
            ]
        )
    )
    is_key = (
        F.lit(not sampled)
        & (F.col("null_count") == 0)
        & (F.col("distinct_count") == F.col("row_count"))
        & (F.col("distinct_count") > 0)
    )
    return merged.select(
        "position",
        "column_name",
        "row_count",
        "null_count",
        (F.col("null_count") / F.greatest(F.col("row_count"), F.lit(1))).alias("null_ratio"),
        "distinct_count",
        is_key.alias("is_candidate_key"),
        "min_value",
        "max_value",
        "outlier_count",
    )


# --- types of text columns ----------------------------------------------------------------------

# The words that count as truth values, and the words in a name that mean a date.
_TRUTH_WORDS = ("true", "false", "0", "1", "yes", "no")
_DATE_WORDS = ("date", "time", "timestamp")
_WHOLE = r"^\s*[+-]?\p{Nd}+(_\p{Nd}+)*\s*$"
_DIGITS = r"\p{Nd}+(_\p{Nd}+)*"
_REAL = (
    rf"(?i)^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})(e[+-]?{_DIGITS})?|inf|infinity|nan)\s*$"
)


def infer_text_types(df: DataFrame) -> DataFrame:
    """Per column: ``column_name`` and the ``logical_type`` its values read as.

    A name that speaks of dates or times decides alone.  Otherwise all values count, empty ones
    aside: truth words, whole numbers, real numbers, few different values, and text in the end.  A
    column of nothing but empty strings meets the first of these tests.

    One scan makes the tests of all columns, on the values themselves where their type says how they
    print.  A second counts different values, of those columns only that have passed no test; which
    they are it learns from the first, as one row.
    """
    names = visible(df)
    words = ", ".join(f"'{word}'" for word in _TRUTH_WORDS)
    tests = {
        BOOLEAN: f"octet_length(x) <= 5 and lower(x) in ({words})",
        INTEGER: f"x rlike r'{_WHOLE}'",
        FLOAT: f"x rlike r'{_REAL}'",
    }
    typed = [_tests_by_type(dtype(df, n)) for n in names]
    texts = df.select(*[
        (col(df, n) if typed[i] else v.as_text(df, n)).alias(f"x{i}") for i, n in enumerate(names)
    ])
    made, verdicts = [], []
    for i, name in enumerate(names):
        made.append(F.count(f"x{i}").alias(f"n{i}"))
        verdict = F.when(F.col(f"n{i}") == 0, UNKNOWN)
        if any(word in name.lower() for word in _DATE_WORDS):
            verdict = F.lit(DATETIME)
        else:
            for kind, test in (typed[i] or tests).items():
                empty = "" if typed[i] else f"x{i} = '' or "
                passed = empty + re.sub(r"\bx\b", f"x{i}", test)
                made.append(F.expr(f"bool_and({passed})").alias(f"{kind}{i}"))
                verdict = verdict.when(F.col(f"{kind}{i}"), kind)
        verdicts.append(F.struct(verdict.alias("found"), F.col(f"n{i}").alias("n")))
    first = texts.agg(*made).select(F.array(*verdicts).alias("columns"))

    told = texts.withColumn("columns", first.scalar())
    cells = ", ".join(
        f"if(columns[{i}].found is null, struct({i} as position, {v.key_sql(f'x{i}', T.StringType())} as k), null)"
        for i in range(len(names))
        if not typed[i]
    ) or "cast(null as struct<position: int, k: string>)"
    different = (
        told.selectExpr(f"inline(array({cells}))")
        .filter("k <> ''")
        .distinct()
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("different"))
    )
    labels = F.array(*[F.lit(n) for n in names])
    every = df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("position"))
    few = F.col("different") <= F.greatest(F.lit(10), F.floor(F.col("column.n") / 5))
    return (
        every.withColumn("column", F.element_at(first.scalar(), F.col("position") + 1))
        .join(different, "position", "left")
        .select(
            F.element_at(labels, F.col("position") + 1).alias("column_name"),
            F.coalesce("column.found", F.when(few, CATEGORICAL).otherwise(TEXT)).alias("logical_type"),
        )
    )


def _tests_by_type(data_type: T.DataType) -> dict[str, str]:
    """The tests of a type whose values always print as whole or real numbers or truth words."""
    if isinstance(data_type, T.BooleanType):
        return {BOOLEAN: "x is not null or true"}
    if isinstance(data_type, T.IntegralType):
        return {BOOLEAN: "x in (0, 1)", INTEGER: "x is not null or true"}
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return {FLOAT: "x is not null or true"}
    return {}
