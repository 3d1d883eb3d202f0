"""Table functions and aggregates of the user's own."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.operators import user_functions
from tablewright.operators.user_functions import aggregated, register_table_function
from tablewright.plans.pipeline import CleaningPipeline
from tablewright_queries.functions import ROOT_MEAN_SQUARE, LinesOf


def _rms(values):
    return math.sqrt(sum(v * v for v in values) / len(values)) if values else None


def test_aggregate_of_a_hot_key_equals_plain_python(spark):
    df = spark.range(0, 30_000, numPartitions=12).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 101).cast("double")).alias("x"),
    )
    groups = {}
    for row in df.collect():
        groups.setdefault(row.key, []).extend([] if row.x is None else [row.x])
    found = {r.key: r.rms for r in aggregated(df, ROOT_MEAN_SQUARE, ["x"], ["key"], "rms").collect()}
    assert found.keys() == groups.keys()
    assert all(found[k] == pytest.approx(_rms(v)) for k, v in groups.items())


def test_states_are_passed_on_when_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(user_functions, "HELD_STATES", 10)
    df = spark.range(0, 3000, numPartitions=2).select((F.col("id") % 1000).alias("k"), F.lit(2.0).alias("x"))
    rows = aggregated(df, ROOT_MEAN_SQUARE, ["x"], ["k"], "rms").collect()
    assert len(rows) == 1000 and {r.rms for r in rows} == {2.0}


def test_aggregate_keys_of_all_kinds(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), 1.0), (None, float("nan"), 1.0), (1, 0.0, None), (1, -0.0, 3.0)],
        "part int, state double, `v0.x` double",
    ).withColumn("t", F.lit("2024-05-01 10:00:00").cast("timestamp"))
    rows = aggregated(df, ROOT_MEAN_SQUARE, ["v0.x"], ["part", "state", "t"], "result").collect()
    assert sorted((r.part or 0, r.result) for r in rows) == [(0, 1.0), (1, 3.0)]
    assert {r.t.hour for r in rows} == {10}
    whole = aggregated(df, ROOT_MEAN_SQUARE, ["v0.x"], [], "r").collect()
    assert [r.r for r in whole] == [pytest.approx(math.sqrt(11 / 3))]
    assert aggregated(df.limit(0), ROOT_MEAN_SQUARE, ["v0.x"], ["part"], "r").collect() == []


def test_aggregate_errors(spark):
    df = spark.range(3).withColumn("a", F.array("id"))
    for by, name in ((["a"], "r"), (["id"], "id"), (["none"], "r")):
        with pytest.raises(RequestError):
            aggregated(df, ROOT_MEAN_SQUARE, ["id"], by, name)
    with pytest.raises(RequestError):
        CleaningPipeline.of(("root_mean_square", {"by": ["id"]})).apply(df)


def test_table_functions_tell_their_columns_from_their_arguments(spark):
    df = spark.createDataFrame([(1, "a\nbc"), (2, None), (3, "")], "n smallint, body string")
    args = {"args": {"key": "n", "text": "body"}}
    result = CleaningPipeline.of(("lines_of", args)).apply(df)
    assert result.dtypes == [("n", "smallint"), ("line_no", "bigint"), ("n_chars", "bigint")]
    assert sorted(tuple(r) for r in result.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 0), (3, 1, 0)]
    assert "Exchange" not in result._jdf.queryExecution().executedPlan().toString()
    assert CleaningPipeline.of(("lines_of", args)).apply(df.limit(0)).collect() == []


def test_table_function_errors(spark):
    with pytest.raises(RequestError):
        register_table_function("nothing", object)
    with pytest.raises(RequestError):
        register_table_function("dedupe", LinesOf)
    with pytest.raises(RequestError):
        CleaningPipeline.of(("lines_of", {"args": {}, "order_by": ["id"]})).apply(spark.range(1))
