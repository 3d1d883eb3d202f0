"""What tables hold: row counts, column descriptions and columns that tables share."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import ORDINAL, field_logical_type


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows.  No column is read for it."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: ``table_name`` and ``row_count``."""
    counts = [
        row_count(df).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def describe_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of every table, from the schemas alone."""
    rows = [
        (name, field.name, position, field_logical_type(field), field.nullable)
        for name, df in tables.items()
        for position, field in enumerate(f for f in df.schema.fields if f.name != ORDINAL)
    ]
    return spark.createDataFrame(
        rows,
        "table_name string, column_name string, position int, logical_type string, "
        "nullable boolean",
    )


def relationship_hints(columns: DataFrame) -> DataFrame:
    """Pairs of tables that share column names, whatever their case, with the shared names sorted.

    ``columns`` is a column description; the pairs come from an equi-join on the name.
    """
    named = columns.select("table_name", F.lower("column_name").alias("name")).distinct()
    left = named.select(F.col("table_name").alias("left_table"), "name")
    right = named.select(F.col("table_name").alias("right_table"), "name")
    return (
        left.join(right, "name")
        .filter(F.col("left_table") != F.col("right_table"))
        .groupBy("left_table", "right_table")
        .agg(F.array_sort(F.collect_set("name")).alias("shared_columns"))
    )
