"""Cells with line breaks, constants of a column's type, whole-row dedupe, samples without a gathering task."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions.columns import ORDINAL
from tablewright.operators.cleaning import dedupe, replace_values
from tablewright.operators.paging import numbered, with_ordinal
from tablewright.operators.sampling import exact_sample
from tablewright.sinks.tabular import write_csv
from tablewright.sources.delimited import read_delimited

_TEXTS = ["plain", 'a "quoted" one', "two\nlines", "\r\nstarts and ends\r", "  spaces  ", "a,b;c\td", '"', "\n", 'x"\ny,z', "\\", 'a\\"b']


def test_cells_with_line_breaks_come_back(spark, tmp_path):
    rows = [(i, t, f"{t}!") for i, t in enumerate(_TEXTS)]
    df = spark.createDataFrame(rows, "id long, text string, more string").repartition(3)
    write_csv(df, str(tmp_path / "csv"))
    found = read_delimited(spark, str(tmp_path / "csv"), delimiter=",", multiline=True)
    assert found.dtypes == df.dtypes
    assert sorted(tuple(r) for r in found.collect()) == rows
    with pytest.raises(Exception, match="(?i)malformed|not a"):
        read_delimited(spark, str(tmp_path / "csv"), delimiter=",").collect()


def test_replacing_keeps_the_type(spark):
    df = spark.createDataFrame([(5, "a"), (None, "b"), (7, "5")], "n int, s string")
    assert replace_values(df, "n", 5, 6).dtypes == [("s", "string"), ("n", "int")]
    assert sorted(r.n or 0 for r in replace_values(df, "n", "5", 6.0).collect()) == [0, 6, 7]
    for old in (5.5, "x", None, 2**40):
        assert sorted(r.n or 0 for r in replace_values(df, "n", old, 1).collect()) == [0, 5, 7]
    for new in (0.5, "x", 2**31):
        with pytest.raises(RequestError):
            replace_values(df, "n", 5, new)
    assert [r.n for r in replace_values(df, "n", 5, None).collect()] == [None, None, 7]


def test_whole_rows_of_a_stored_table_are_told_apart_by_digests(spark):
    long = "x" * 20_000
    rows = [(1, long, 0.0), (2, long, 1.0), (1, long, -0.0), (1, None, float("nan")), (1, None, float("nan"))]
    df = with_ordinal(spark.createDataFrame(rows * 3, "a int, s string, d double").coalesce(1))
    found = dedupe(df)
    assert found.columns == df.columns
    assert sorted(r[ORDINAL] for r in found.collect()) == [0, 1, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "min_by" in plan


def test_samples_of_any_size_are_exact(spark):
    df = spark.range(3_000, numPartitions=8).select("id", (F.col("id") % 3).alias("k"))
    drawn = {}
    for rows in (0, 1, 700, 2_999, 3_000, 5_000):
        drawn[rows] = exact_sample(df, rows, ["id"])
        ids = [r.id for r in drawn[rows].collect()]
        assert len(ids) == len(set(ids)) == min(rows, 3_000)
    assert {r.id for r in drawn[1].collect()} < {r.id for r in drawn[700].collect()} < {r.id for r in drawn[2_999].collect()}
    # Keys that many rows share draw alike; so many of them are taken as are wanted.
    alike = Counter(r.k for r in exact_sample(df, 1_500, ["k"]).collect())
    assert sum(alike.values()) == 1_500 and sorted(alike.values())[-1] == 1_000
    parts = exact_sample(df, 1_500, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1


def test_samples_and_numbers_of_a_stored_table_keep_its_ordinals(spark):
    df = with_ordinal(spark.range(300, numPartitions=4).select(F.col("id").alias("n")))
    own = {(r.n, r[ORDINAL]) for r in df.collect()}
    assert {(r.n, r[ORDINAL]) for r in exact_sample(df, 40).select("n", ORDINAL).collect()} < own
    placed = numbered(df, [F.desc("n")], "place").collect()
    assert {(r.n, r[ORDINAL]) for r in placed} == own and all(r.place == 299 - r.n for r in placed)
