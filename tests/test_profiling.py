"""Column statistics, sampling, type inference and relationship hints."""

from __future__ import annotations

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.operators import catalog, profiling
from tablewright.operators.sampling import exact_sample
from tablewright.plans.profile import profile_report


def _by_column(df):
    return {r.column_name: r for r in df.collect()}


def test_small_profile(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (1, "y")], "id long, city string")
    report = profile_report(df)
    rows = _by_column(report.columns)
    assert set(rows) == {"id", "city"}
    assert rows["city"].null_count == 1 and abs(rows["city"].null_ratio - 1 / 3) < 1e-12
    assert rows["city"].distinct_count == 2 and rows["id"].distinct_count == 2
    assert not rows["id"].is_candidate_key and not rows["city"].is_candidate_key
    assert (rows["id"].min_value, rows["id"].max_value) == ("1", "2")
    assert rows["id"].logical_type == "integer" and rows["city"].logical_type == "text"
    assert sorted(rows["city"].sample_values) == ["x", "y"]
    assert tuple(report.summary.head()) == (3, 0, False)


def test_sales_profile(spark):
    rows = [
        (f"R{i % 4}", f"P{i % 3}", i + 1, 10.5 * (i + 1), f"2024-01-{i + 1:02d}") for i in range(10)
    ]
    df = spark.createDataFrame(rows, "region string, product string, units long, revenue double, d string")
    df = df.withColumn("d", F.to_date("d"))
    found = _by_column(profiling.profile_columns(df))
    assert [found[n].distinct_count for n in df.columns] == [4, 3, 10, 10, 10]
    assert [n for n in df.columns if found[n].is_candidate_key] == ["units", "revenue", "d"]
    assert all(r.null_count == 0 and r.outlier_count == 0 for r in found.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = _by_column(profile_report(df).columns)
    assert rows["a"].row_count == 0 and rows["a"].null_ratio == 0.0
    assert rows["a"].distinct_count == 0 and not rows["a"].is_candidate_key
    assert rows["b"].min_value is None and rows["b"].sample_values == []


def test_outliers_agree_with_brute_force(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [50.0, -40.0, None]
    known = [x for x in values if x is not None]
    mean, sigma = statistics.mean(known), statistics.stdev(known)
    expected = sum(abs(x - mean) > 3 * sigma for x in known)
    df = spark.createDataFrame([(x, 7) for x in values], "v double, same int")
    found = _by_column(profiling.outlier_counts(df))
    assert found["v"].outlier_count == expected and found["same"].outlier_count == 0


@pytest.fixture
def mixed(spark):
    rng = random.Random(5)
    rows = [
        (
            rng.randint(0, 50), rng.choice([0.0, -0.0, 1.5, float("nan"), None]),
            rng.choice(["a", "", None, "x" * 100, "y" * 100]), rng.choice([True, False, None]),
            rng.choice([[1, 2], [3], None]), None,
        )
        for _ in range(800)
    ]
    return spark.createDataFrame(
        rows, "i int, d double, s string, b boolean, l array<int>, n string"
    ).withColumn("t", F.timestamp_seconds(F.col("i") % 7).cast("timestamp_ntz"))


EXPECTED = {"d": 3, "s": 4, "b": 2, "l": 2, "n": 0, "t": 7}


def test_distinct_counts_column_by_column_and_unpivoted(mixed, monkeypatch):
    narrow = {r.column_name: r.distinct_count for r in profiling.distinct_counts(mixed).collect()}
    assert EXPECTED.items() <= narrow.items()
    monkeypatch.setattr(profiling, "COLUMNWISE_LIMIT", 2)
    wide = {r.column_name: r.distinct_count for r in profiling.distinct_counts(mixed).collect()}
    assert wide == narrow


def test_wide_table(spark):
    df = spark.range(300).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(120)])
    found = {r.column_name: r.distinct_count for r in profiling.distinct_counts(df).collect()}
    assert found == {f"c{i}": i + 1 for i in range(120)}
    rows = _by_column(profiling.profile_columns(df))
    assert len(rows) == 120 and rows["c119"].max_value == "119"


def test_approximate_counts_are_close(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10).alias("m"))
    found = {r.column_name: r.distinct_count for r in profiling.distinct_counts(df, True).collect()}
    assert abs(found["id"] - 5000) < 750 and found["m"] == 10


def test_duplicates_count_rows_beyond_the_first(mixed, spark):
    df = spark.createDataFrame([(1, None)] * 3 + [(None, 1)] * 2 + [(2, 2)], "a int, b int")
    assert profiling.duplicate_rows(df).head()[0] == 3
    brute = sum(
        n - 1
        for n in Counter(
            (r.i, "nan" if r.d != r.d else r.d, r.s, r.b, tuple(r.l) if r.l else None, r.t)
            for r in mixed.collect()
        ).values()
    )
    assert profiling.duplicate_rows(mixed).head()[0] == brute
    assert profiling.duplicate_rows(df.limit(0)).head()[0] == 0


def test_samples_are_the_first_values(spark):
    df = spark.range(0, 1000, numPartitions=7).select(
        (999 - F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("even")
    )
    rows = profiling.sample_values(df).collect()
    by = lambda name: [r.sample_value for r in sorted(rows, key=lambda r: r.sample_no)
                       if r.column_name == name]
    assert by("n") == ["999", "998", "997", "996", "995"]
    assert by("even") == ["0", "2", "4", "6", "8"]
    rows = profiling.sample_values(df, order_by="n").collect()
    assert by("n") == ["0", "1", "2", "3", "4"]
    assert by("even") == ["998", "996", "994", "992", "990"]


def test_samples_of_rows_without_a_place(spark):
    df = spark.createDataFrame([(None, "x"), (2, "b"), (1, "a")], "o int, v string")
    rows = profiling.sample_values(df, order_by="o").filter("column_name = 'v'").collect()
    assert [r.sample_value for r in sorted(rows, key=lambda r: r.sample_no)] == ["a", "b", "x"]


def test_columns_called_like_working_columns(spark):
    names = ["_rank", "_position", "_moments", "moments", "draw", "tie", "rank", "place"]
    df = spark.range(20).select(*[(F.col("id") + i).alias(n) for i, n in enumerate(names)])
    report = profile_report(df, order_by="place")
    assert {r.distinct_count for r in report.columns.collect()} == {20}
    assert exact_sample(df, 5).columns == names and exact_sample(df, 5).count() == 5


def test_samples_with_equal_positions(spark):
    df = spark.createDataFrame([(1, str(i)) for i in range(50)], "o int, v string")
    rows = profiling.sample_values(df, order_by="o").filter("column_name = 'v'").collect()
    assert sorted(r.sample_no for r in rows) == [1, 2, 3, 4, 5]


def test_exact_sample(spark):
    df = spark.range(0, 20_000, numPartitions=9)
    sample = [r.id for r in exact_sample(df, 1000).collect()]
    assert len(sample) == len(set(sample)) == 1000
    # Every tenth of the table should be about equally represented.
    assert all(50 < n < 160 for n in Counter(i // 2000 for i in sample).values())
    assert exact_sample(df, 50_000).count() == 20_000
    assert sorted(sample) == sorted(r.id for r in exact_sample(df.repartition(3), 1000, ["id"]).collect())


def test_sampled_report_describes_one_sample(spark):
    df = spark.range(0, 5000, numPartitions=5).select("id", (F.col("id") % 3).alias("m"))
    report = profile_report(df, sample_rows=400)
    rows = _by_column(report.columns)
    assert report.sampled and tuple(report.summary.head()) == (5000, 0, True)
    assert {r.row_count for r in rows.values()} == {400}
    assert rows["id"].distinct_count == 400 and not rows["id"].is_candidate_key
    full = profile_report(df, name="a", others={"b": df.select("id")})
    assert not full.sampled and _by_column(full.columns)["id"].is_candidate_key
    assert {(r.left_table, r.right_table) for r in full.hints.collect()} == {("a", "b"), ("b", "a")}


@pytest.mark.parametrize(
    ("name", "values", "expected"),
    [
        ("amount", ["1", "2"], "integer"),
        ("flag", ["true", "false"], "boolean"),
        ("flag", ["1", "0", "yes"], "boolean"),
        ("x", ["1.5", "", "2"], "float"),
        ("x", ["1e5", "nan", "-inf", ".5"], "float"),
        ("x", [" 12 ", "+3", "1_000"], "integer"),
        ("x", ["a", "b", "a"], "categorical"),
        ("x", [str(i) + "z" for i in range(60)], "text"),
        ("x", ["", ""], "boolean"),
        ("x", [None], "unknown"),
        ("time_spent", ["1", "2"], "datetime"),
        ("orderDate", ["x"], "datetime"),
    ],
)
def test_type_inference(spark, name, values, expected):
    df = spark.createDataFrame([(x,) for x in values], f"`{name}` string")
    assert [tuple(r) for r in profiling.infer_text_types(df).collect()] == [(name, expected)]


def test_relationship_hints_ignore_case(spark):
    tables = {
        "a": spark.createDataFrame([], "Id int, City string"),
        "b": spark.createDataFrame([], "id int, CITY string, x int"),
        "c": spark.createDataFrame([], "y int"),
    }
    columns = catalog.describe_columns(spark, tables)
    hints = catalog.relationship_hints(columns).collect()
    assert {(r.left_table, r.right_table, tuple(r.shared_columns)) for r in hints} == {
        ("a", "b", ("city", "id")), ("b", "a", ("city", "id")),
    }


def test_profile_reads_each_column_as_often_as_it_must(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 0.5 d").write.parquet(path)
    df = spark.read.parquet(path)
    basic = profiling.basic_statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in basic
    counts = profiling.distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    for column in ("id:bigint", "s:string", "d:"):
        assert counts.count(f"ReadSchema: struct<{column}") == 1


def test_inference_reads_a_table_as_often_for_many_columns(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = profiling.infer_text_types(orders)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Relation [") <= 3


def test_inference_of_typed_columns(spark):
    df = spark.createDataFrame(
        [(True, 0, 5, float("nan"), None, "yes"), (None, 1, -1, 2.0, None, "")],
        "b boolean, bit int, n smallint, x float, none bigint, t string",
    )
    found = {r.column_name: r.logical_type for r in profiling.infer_text_types(df).collect()}
    assert found == {"b": "boolean", "bit": "boolean", "n": "integer", "x": "float", "none": "unknown", "t": "boolean"}
    empty = profiling.infer_text_types(df.limit(0).select("n", "t")).collect()
    assert {tuple(r) for r in empty} == {("n", "unknown"), ("t", "unknown")}
