"""Cleaning steps and pipelines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.operators import cleaning as s
from tablewright.plans.pipeline import CleaningPipeline


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [(" Ann ", 1), ("Ann", None), ("Bob", 2)], "name string, value long"
    )


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trim_fill_dedupe_and_replay(people):
    pipeline = CleaningPipeline.of(
        ("trim_column", {"column": "name"}),
        ("fill_null", {"column": "value", "value": 0}),
        ("dedupe", {"columns": ["name"]}),
    )
    once = pipeline.apply(people)
    assert sorted(r["name"] for r in once.collect()) == ["Ann", "Bob"]
    again = CleaningPipeline.from_json(pipeline.to_json())
    assert again.to_list() == pipeline.to_list()
    assert again.apply(people).count() == 2


def test_rewritten_columns_move_to_the_end(people):
    assert s.trim_column(people, "name").columns == ["value", "name"]
    assert s.rename_column(people, "name", "who").columns == ["value", "who"]
    assert s.cast_column(people, "name", "varchar").columns == ["value", "name"]
    assert s.fill_null(people, "name", "x").columns == ["value", "name"]
    assert s.replace_values(people, "name", "a", "b").columns == ["value", "name"]


def test_drop_columns(people):
    assert s.drop_columns(people, ["value"]).columns == ["name"]
    assert s.drop_columns(people, []).columns == ["name", "value"]
    with pytest.raises(RequestError):
        s.drop_columns(people, ["nothing"])


def test_drop_nulls_keeps_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)],
                               "d double, s string")
    assert [r.s for r in s.drop_nulls(df, ["d", "s"]).collect()] == ["a", "b"]
    with pytest.raises(RequestError) as failure:
        s.drop_nulls(df, [])
    assert failure.value.code == "no_columns"


def test_replace_never_matches_null(people):
    assert _rows(s.replace_values(people, "value", None, 9)) == _rows(people.select("name", "value"))
    assert [r.value for r in s.replace_values(people, "value", 1, None).collect()] == [None, None, 2]


def test_fill_with_another_type(people):
    with pytest.raises(RequestError):
        s.fill_null(people, "value", 1.5)
    money = people.selectExpr("name", "cast(value as decimal(10, 2)) as value")
    filled = s.fill_null(money, "value", 1.5)
    assert filled.dtypes[-1] == ("value", "decimal(10,2)")
    assert sorted(float(r.value) for r in filled.collect()) == [1.0, 1.5, 2.0]
    with pytest.raises(RequestError):
        s.fill_null(money, "value", "0.125")
    assert [r.value for r in s.fill_null(people, "value", "7").orderBy("name").collect()] == [1, 7, 2]
    with pytest.raises(RequestError) as failure:
        s.fill_null(people, "value", "many")
    assert failure.value.code == "bad_literal"


def test_cast_fails_on_bad_text(people):
    with pytest.raises(Exception, match="cannot convert '"):
        s.cast_column(people, "name", "BIGINT").collect()
    with pytest.raises(RequestError):
        s.cast_column(people, "name", "JSON")


@pytest.mark.parametrize(
    ("operator", "value", "expected"),
    [("=", 1, [1]), ("!=", 1, [2]), (">", 1, [2]), (">=", 1, [1, 2]), ("<", 1.5, [1]),
     ("<=", "2", [1, 2]), ("=", None, []), ("LIKE", "2", [2]), ("LIKE", None, [])],
)
def test_filter_rows(people, operator, value, expected):
    kept = s.filter_rows(people, "value", operator, value).collect()
    assert sorted(r.value for r in kept) == expected


def test_filter_rejects_other_operators(people):
    with pytest.raises(RequestError) as failure:
        s.filter_rows(people, "value", "IN", 1)
    assert failure.value.code == "filter_sign"


def test_dedupe_keeps_the_first_by_order(spark):
    df = spark.createDataFrame(
        [("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 0, "w"), ("b", None, "v")],
        "k string, o int, p string",
    )
    kept = s.dedupe(df, ["k"], order_by=["o"])
    assert {(r.k, r.p) for r in kept.collect()} == {("a", "y"), (None, "w"), ("b", "v")}


def test_dedupe_without_columns_keeps_distinct_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "a int, b string")
    assert _rows(s.dedupe(df)) == [(1, "a"), (1, None)] or s.dedupe(df).count() == 2
    stored = df.withColumn("_ordinal", F.monotonically_increasing_id())
    assert s.dedupe(stored).count() == 2


def test_dedupe_trims_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as o")
    plan = s.dedupe(df, ["k"], order_by=["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan


def test_unknown_steps_are_rejected(people):
    with pytest.raises(RequestError) as failure:
        CleaningPipeline.of(("explode", {})).apply(people)
    assert failure.value.code == "no_such_step"


def test_custom_step_validates_its_parameters(people):
    def check(params):
        if "column" not in params:
            raise ValueError("column is missing")

    s.register_step("shout", lambda df, p: df.withColumn(p["column"], F.upper(p["column"])), check)
    step = CleaningPipeline.of(("shout", {"column": "name"}))
    assert "BOB" in {r.name for r in step.apply(people).collect()}
    with pytest.raises(ValueError, match="missing"):
        CleaningPipeline.of(("shout", {})).apply(people)
    with pytest.raises(RequestError):
        s.register_step("dedupe", lambda df, p: df)


def test_dotted_and_spaced_names(spark):
    df = spark.createDataFrame([(1, " x ")], "`a.b` int, `c d` string")
    cleaned = CleaningPipeline.of(
        ("trim_column", {"column": "c d"}),
        ("filter_rows", {"column": "a.b", "operator": "=", "value": 1}),
        ("rename_column", {"from": "a.b", "to": "e`f"}),
    ).apply(df)
    assert cleaned.columns == ["c d", "e`f"]
    assert tuple(cleaned.head()) == ("x", 1)


def test_pipeline_is_one_projection_over_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "' a ' as s", "id * 2 as n").write.parquet(path)
    plan = (
        CleaningPipeline.of(
            ("trim_column", {"column": "s"}),
            ("fill_null", {"column": "n", "value": 0}),
            ("filter_rows", {"column": "id", "operator": ">", "value": 3}),
            ("drop_columns", {"columns": ["n"]}),
        )
        .apply(spark.read.parquet(path))
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert plan.count("Project") == 1 and "Exchange" not in plan
    assert "GreaterThan(id,3)" in plan
    assert "ReadSchema: struct<id:bigint,s:string>" in plan


def test_missing_parameters_are_named(spark):
    with pytest.raises(RequestError, match="duck_type"):
        CleaningPipeline.of(("cast_column", {"column": "a"})).apply(spark.range(1))


def test_dedupe_keeps_a_column_called_rank(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "rank int, _rank int")
    kept = s.dedupe(df, ["rank"], ["_rank"])
    assert kept.columns == ["rank", "_rank"] and sorted(r["_rank"] for r in kept.collect()) == [5, 7]
