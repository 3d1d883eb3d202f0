"""Column profiles as sketches, which can be merged: a changed table reads its changed parts only.

Every column has a HyperLogLog sketch of its values, every number a KLL sketch of its quantiles
beside it.  They are Spark's own aggregates, combined in the task before the shuffle and of a size
that does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import values as v
from tablewright.functions.columns import dtype, quoted, select_all, sql_text, visible
from tablewright.operators.profiling import is_number

#: Size of the sketches.  2^14 registers: a standard error of 0.8 % of the distinct count; k = 400: a
#: median's rank is off by 0.9 % of the rows at most, in 99 of 100 sketches.
REGISTERS, KLL_SIZE = 14, 400
#: What a distinct count and a quantile's rank may be off by: four and two times these errors.
DISTINCT_ERROR, RANK_ERROR = 0.033, 0.018


def sketched(df: DataFrame, *by: Column) -> DataFrame:
    """Per part, as ``by`` tells them, and column: counts and the sketches of its values.

    ``column_name``, ``position``, ``row_count``, ``null_count``, ``distinct`` and, for numbers,
    ``quantiles``; NULL where there are no values.  NaN counts as a value, but has no rank.
    """
    names = visible(df)
    aggregates, rows = ["count(1) as rows"], []
    for i, name in enumerate(names):
        x, data_type = quoted(name), dtype(df, name)
        whole = isinstance(data_type, T.IntegralType)
        key = f"cast({x} as bigint)" if whole else f"cast({v.key_sql(_one_zero(x, data_type), data_type)} as string)"
        aggregates += [f"count({x}) as present{i}", f"hll_sketch_agg({key}, {REGISTERS}) as h{i}"]
        quantiles = "cast(null as binary)"
        if is_number(df, name):
            aggregates.append(f"kll_sketch_agg_double({v.double_sql(x, data_type)}, {KLL_SIZE}) as q{i}")
            quantiles = f"if(present{i} > 0, q{i}, null)"
        rows.append(
            f"""struct({sql_text(name)} as column_name, {i} as position, rows as row_count,
                       rows - present{i} as null_count, if(present{i} > 0, h{i}, null) as distinct,
                       {quantiles} as quantiles)"""
        )
    parts = [part.alias(f"by{i}") for i, part in enumerate(by)]
    labels = [f"by{i}" for i in range(len(by))]
    wide = df.groupBy(*parts).agg(*[F.expr(a) for a in aggregates])
    return wide.selectExpr(*labels, f"inline(array({', '.join(rows)}))")


def _one_zero(x: str, data_type: T.DataType) -> str:
    return f"({x} + 0)" if isinstance(data_type, (T.FloatType, T.DoubleType)) else x


def merged(sketches: DataFrame) -> DataFrame:
    """One row per column from the sketches of all parts.

    Counts of rows and NULLs are exact, as are the least and the greatest number.  ``distinct_count``
    and the ``quartiles`` are within DISTINCT_ERROR and RANK_ERROR.
    """
    # A part without numbers has no sketch; one of NaN alone has an empty one, without quantiles.
    parts = sketches.withColumn(
        "quantiles", F.expr("if(kll_sketch_get_n_double(quantiles) > 0, quantiles, null)")
    )
    met = parts.groupBy("position", "column_name").agg(
        F.sum("row_count").alias("row_count"),
        F.sum("null_count").alias("null_count"),
        F.expr("hll_sketch_estimate(hll_union_agg(distinct, false))").alias("estimate"),
        F.count("quantiles").alias("n"),
        F.expr(f"kll_merge_agg_double(quantiles, {KLL_SIZE})").alias("all"),
    )
    ranks = "array(0.0D, 0.25D, 0.5D, 0.75D, 1.0D)"
    points = met.withColumn("points", F.expr(f"if(n > 0, kll_sketch_get_quantile_double(all, {ranks}), null)"))
    present = F.col("row_count") - F.col("null_count")
    return points.select(
        "position",
        "column_name",
        "row_count",
        "null_count",
        F.least(F.when(present > 0, F.col("estimate")).otherwise(0), present).alias("distinct_count"),
        F.col("points")[0].alias("least"),
        F.slice("points", 2, 3).alias("quartiles"),
        F.col("points")[4].alias("greatest"),
    )


def profile_sketch(df: DataFrame) -> DataFrame:
    """The profile of a whole table from sketches: one scan, whatever the number of columns."""
    return merged(sketched(df.select(*select_all(visible(df)))))
