"""The profile of a whole table: one report on all rows, or on a sample that is asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import ORDINAL, field_logical_type
from tablewright.operators import profiling
from tablewright.operators.catalog import describe_columns, relationship_hints
from tablewright.operators.sampling import exact_sample


@dataclass(frozen=True)
class ProfileReport:
    """``columns`` has one row per column, ``summary`` one row for the table.

    ``hints`` has a row for each column name the table shares with another one, if others were
    given.
    """

    columns: DataFrame
    summary: DataFrame
    sampled: bool
    hints: DataFrame | None = None


def profile_report(
    df: DataFrame,
    *,
    sample_rows: int | None = None,
    sample_keys: Sequence[str] = (),
    order_by: str | None = None,
    approximate: bool = False,
    outliers: bool = True,
    seed: int = 42,
    name: str | None = None,
    others: Mapping[str, DataFrame] | None = None,
) -> ProfileReport:
    """Profile all rows of ``df``, or a sample of ``sample_rows`` of them.

    A sample is drawn once and written to the shared folder, so that all statistics describe the
    same rows.  ``others`` are tables by name, among which ``name`` is this one.
    """
    total = df.count()
    sampled = sample_rows is not None and total > sample_rows
    basis = exact_sample(df, sample_rows, sample_keys, seed) if sampled else df
    types = [
        (f.name, field_logical_type(f)) for f in df.schema.fields if f.name != ORDINAL
    ]
    names = F.create_map(*[F.lit(part) for pair in types for part in pair])
    samples = (
        profiling.sample_values(basis, order_by)
        .groupBy("column_name")
        .agg(F.sort_array(F.collect_list(F.struct("sample_no", "sample_value"))).alias("s"))
        .select("column_name", F.col("s.sample_value").alias("sample_values"))
    )
    columns = (
        profiling.profile_columns(basis, sampled, approximate, outliers)
        .withColumn("logical_type", names[F.col("column_name")])
        .join(samples, "column_name", "left")
        .withColumn(
            "sample_values",
            F.coalesce("sample_values", F.array().cast("array<string>")),
        )
    )
    summary = profiling.duplicate_rows(basis).select(
        F.lit(total).cast("bigint").alias("row_count"),
        F.col("duplicate_count").alias("duplicate_row_count"),
        F.lit(sampled).alias("sampled"),
    )
    hints = None
    if others is not None and name is not None:
        described = describe_columns(df.sparkSession, {**others, name: df})
        hints = relationship_hints(described).filter(
            (F.col("left_table") == name) | (F.col("right_table") == name)
        )
    return ProfileReport(columns, summary, sampled, hints)
