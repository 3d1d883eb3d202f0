"""Columnar tables in folders by column value."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.sources.partitioned import read_partitioned, write_partitioned
from tablewright_queries.files import src_partitioned
from tablewright_queries.registry import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_years_from_a_join_prune_folders(spark):
    plan = _plan(src_partitioned(Tables(spark, "/root/testdata/sf0.001")))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "ship_year" in line)
    assert "dynamicpruning" in scan.split("PartitionFilters: ")[1]


@pytest.mark.parametrize("form", ["parquet", "orc"])
def test_constants_prune_and_missing_columns_are_null(spark, tmp_path, form):
    path = str(tmp_path / form)
    old = spark.createDataFrame([(1, "01"), (2, "02"), (3, None)], "a int, code string")
    new = spark.createDataFrame([(True, "01", 9)], "b boolean, code string, a int")
    write_partitioned(old, path, ["code"], form=form)
    write_partitioned(new, path, ["code"], form=form, append=True)
    df = read_partitioned(spark, path, form=form, partitions="code string")
    rows = sorted((r.a, r.b, r.code) for r in df.collect())
    assert rows == [(1, None, "01"), (2, None, "02"), (3, None, None), (9, True, "01")]
    first = df.filter("code = '01'")
    assert "PartitionFilters: [isnotnull(code" in _plan(first)
    assert sorted(r.a for r in first.collect()) == [1, 9]


def test_a_stated_schema_widens_numbers(spark, tmp_path):
    path = str(tmp_path / "wide")
    write_partitioned(spark.createDataFrame([(1, 1.5, "x")], "n int, f float, p string"), path, ["p"])
    write_partitioned(spark.createDataFrame([(2**40, 2.5, "x")], "n long, f double, p string"), path, ["p"], append=True)
    df = read_partitioned(spark, path, partitions="p string", schema="n bigint, f double, later string")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1.5, None, "x"), (2**40, 2.5, None, "x")]


def test_a_hot_folder_is_many_files_and_small_ones_are_one(spark, tmp_path):
    df = spark.range(0, 80_000, numPartitions=8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("t"),
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(-1).alias("p"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        write_partitioned(df, str(tmp_path / "hot"), ["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in Path(tmp_path / "hot").glob("p=*")}
    assert files["p=-1"] > 3 and sum(files.values()) - files["p=-1"] < 80


def test_errors(spark, tmp_path):
    df = spark.range(3).withColumn("p", F.lit(1))
    for call in (
        lambda: write_partitioned(df, str(tmp_path / "a"), []),
        lambda: write_partitioned(df, str(tmp_path / "a"), ["id", "p"]),
        lambda: write_partitioned(df, str(tmp_path / "a"), ["x"]),
        lambda: write_partitioned(df, str(tmp_path / "a"), ["p"], form="avro"),
        lambda: read_partitioned(spark, str(tmp_path), form="csv"),
    ):
        with pytest.raises(RequestError):
            call()
