"""Chart queries, their caps and options, dashboards and reports."""

from __future__ import annotations

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.operators import charts as c
from tablewright.plans import dashboard as d


@pytest.fixture
def sales(spark):
    return spark.createDataFrame(
        [("A", 10.0), ("A", 20.0), ("B", 5.0), ("B", 15.0), ("C", 100.0)],
        "region string, amount double",
    )


def _spec(kind, *fields, **options):
    return c.ChartSpec(kind, tuple(c.Encoding(*f) for f in fields), options)


SUM = (("x", "region"), ("y", "amount", "sum"))


def _pairs(df):
    return [(r.category, r.value) for r in df.collect()]


def test_category_sum_is_capped(sales):
    data = c.chart(sales, _spec("bar", *SUM), max_categories=2)
    assert _pairs(data.rows) == [("A", 30.0), ("B", 20.0)]
    assert data.truncated().head().truncated
    whole = c.chart(sales, _spec("bar", *SUM))
    assert _pairs(whole.rows) == [("A", 30.0), ("B", 20.0), ("C", 100.0)]
    assert not whole.truncated().head().truncated
    assert c.chart(sales, _spec("bar", *SUM), max_categories=3).truncated().head().truncated


@pytest.mark.parametrize(
    ("name", "value"),
    [("sum", 30.0), ("avg", 15.0), ("mean", 15.0), ("AVG", 15.0), ("min", 10.0), ("max", 20.0),
     ("count", 2), ("median", 30.0), (None, 30.0)],
)
def test_aggregates(sales, name, value):
    rows = c.chart(sales, _spec("bar", ("x", "region"), ("y", "amount", name))).rows
    assert _pairs(rows)[0] == ("A", value)


def test_filters(sales):
    def regions(*filters):
        return [p[0] for p in _pairs(c.chart(sales, _spec("bar", *SUM, filters=list(filters))).rows)]

    assert regions({"field": "region", "op": "eq", "value": "A"}) == ["A"]
    assert regions({"field": "region", "op": "neq", "value": "A"}) == ["B", "C"]
    assert regions({"field": "region", "op": "contains", "value": "_"}) == ["A", "B", "C"]
    assert regions({"field": "amount", "value": "100.0"}) == ["C"]
    assert regions("ignored", {"field": "region", "value": None}) == []
    with pytest.raises(RequestError):
        c.chart(sales, _spec("bar", *SUM, filters={"field": "region"}))
    with pytest.raises(RequestError):
        regions({"field": "region", "op": "gt", "value": "A"})
    with pytest.raises(RequestError):
        regions({"field": "nothing", "op": "eq", "value": "A"})


def test_null_categories_come_last(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 2.0)], "k string, v double")
    assert _pairs(c.category_aggregate(df, "k")) == [("a", 2), (None, 1)]
    assert _pairs(c.category_aggregate(df, "k", c.Encoding("y", "v", "count"))) == [
        ("a", 1), (None, 1),
    ]


def test_text_that_is_no_number_is_left_out_of_sums(spark):
    df = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("b", "5d")], "k string, v string")
    assert _pairs(c.category_aggregate(df, "k", c.Encoding("y", "v"))) == [("a", 1.5), ("b", None)]


def test_histogram(sales):
    rows = c.chart(sales, _spec("histogram", ("x", "amount"))).rows.collect()
    assert sum(r.value for r in rows) == 5
    assert [r.category for r in rows] == sorted(r.category for r in rows)
    assert {r.category for r in rows} <= {str(i) for i in range(1, 21)}
    assert "20" in {r.category for r in rows}


def test_histogram_needs_numbers(sales, spark):
    with pytest.raises(Exception, match="needs numbers"):
        c.chart(sales, _spec("histogram", ("x", "region"))).rows.collect()
    with pytest.raises(Exception, match="needs numbers"):
        c.chart(sales.limit(0), _spec("histogram", ("x", "amount"))).rows.collect()
    with pytest.raises(RequestError):
        c.chart(sales, _spec("histogram"))


def test_histogram_of_constant_and_of_infinite_values(spark):
    same = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert _pairs(c.histogram(same, "v")) == [("1", 4)]
    wild = spark.createDataFrame(
        [(float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (10.0,), (None,)], "v double"
    )
    assert _pairs(c.histogram(wild, "v")) == [("1", 1), ("20", 1)]


def test_histogram_agrees_with_brute_force(spark):
    values = [((i * 37) % 1001) / 7 for i in range(2000)]
    low, high = min(values), max(values)
    width = (high - low) / 20
    expected = Counter(min(20, math.floor((x - low) / width) + 1) for x in values)
    df = spark.createDataFrame([(x,) for x in values], "v double")
    assert {r.bin_id: r.value for r in c.histogram(df, "v").collect()} == dict(expected)


def test_histogram_has_no_join(sales):
    rows = c.histogram(sales, "amount")
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_series_and_dense_series(spark):
    df = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 4.0), ("b", None, 8.0)],
        "k string, s string, v double",
    )
    rows = c.chart(df, _spec("bar", ("x", "k"), ("y", "v"), ("series", "s"))).rows
    assert [tuple(r) for r in rows.collect()] == [("a", "x", 3.0), ("b", "y", 4.0), ("b", None, 8.0)]
    assert sorted(tuple(r) for r in c.dense_series(rows).collect()) == [
        ("a", "None", 0.0), ("a", "x", 3.0), ("a", "y", 0.0),
        ("b", "None", 8.0), ("b", "x", 0.0), ("b", "y", 4.0),
    ]


def test_nothing_is_cut_unless_asked(spark):
    df = spark.range(12_000).selectExpr("id", "cast(id as string) as k", "cast(id % 3 as string) as s")
    assert c.chart(df, _spec("bar", ("x", "k"))).rows.count() == 12_000
    assert c.chart(df, _spec("bar", ("x", "k"), ("series", "s"))).rows.count() == 12_000
    assert c.chart(df, _spec("scatter", ("x", "id"), ("y", "id"))).rows.count() == 12_000
    assert c.chart(df, _spec("table")).rows.count() == 12_000
    points = c.line_points(c.category_aggregate(df, "k")).collect()
    assert [r.category for r in sorted(points)] == sorted(str(i) for i in range(12_000))
    assert sorted(r.x for r in points) == list(range(12_000))


def test_grid_with_null_and_its_text(spark):
    rows = spark.createDataFrame([("a", "None", 1.0), ("a", None, 2.0)], "category string, series string, value double")
    assert [tuple(r) for r in c.dense_series(rows).collect()] == [("a", "None", 2.0)]
    with pytest.raises(Exception, match="more than 1 series"):
        c.dense_series(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], rows.schema), most=1).collect()


def test_dashboard_histogram_without_numbers_is_a_text(spark, sales):
    charts = {"h": d.BoundChart(_spec("histogram", ("x", "region")), sales), "bar": d.BoundChart(_spec("bar", *SUM), sales)}
    rows = d.dashboard_sections(spark, d.Dashboard("B", ("h", "bar")), charts).orderBy("section_no").collect()
    assert [(r.kind, r.title) for r in rows] == [("heading", "B"), ("text", "h"), *[("chart", "bar")] * 3]


def test_number_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.createDataFrame([(0.05,), (0.5,)], "d double").write.parquet(path)
    found = c.filtered(spark.read.parquet(path), [{"field": "d", "value": "0.05"}])
    assert [r.d for r in found.collect()] == [0.05]
    assert "EqualTo(d,0.05)" in found._jdf.queryExecution().executedPlan().toString()


def test_line_points_draw_null_as_zero(spark):
    df = spark.createDataFrame([("b", None), ("a", 2.0)], "k string, v double")
    points = c.line_points(c.category_aggregate(df, "k", c.Encoding("y", "v")))
    assert [tuple(r) for r in points.collect()] == [(0, "a", 2.0), (1, "b", 0.0)]


def test_scatter_and_table(spark):
    df = spark.createDataFrame([(3, "1"), (1, "x"), (2, "2"), (None, "3")], "n int, t string")
    points = c.chart(df, _spec("scatter", ("x", "n"), ("y", "t")), order_by=["n"]).rows
    assert [tuple(r) for r in points.collect()] == [(2.0, 2.0), (3.0, 1.0)]
    shown = c.chart(df, _spec("table"), max_points=2, order_by=["n"])
    assert [r.n for r in shown.rows.collect()] == [1, 2]
    assert shown.truncated().head().truncated


def test_sort_top_n_and_null_options(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", None), (None, 9.0)], "k string, v double"
    )

    def shown(**options):
        spec = _spec("bar", ("x", "k"), ("y", "v"), **options)
        return [r.category for r in c.chart(df, spec, apply_options=True).rows.collect()]

    assert shown(sort="Value ↓", top_n=2) == [None, "b"]
    assert shown(sort="Value ↑", null_handling="Treat as zero") == ["d", "a", "c", "b", None]
    assert shown(sort="Category Z→A", null_handling="Skip nulls") == ["c", "b", "a"]
    spec = _spec("bar", ("x", "k"), ("y", "v"), top_n=2, null_handling="Skip nulls")
    assert len(c.chart(df, spec).rows.collect()) == 5


def test_category_caps():
    assert [c.category_cap(n) for n in (100, 2000, 10_000, 10**6)] == [50, 100, 500, 500]


def test_capped_chart_sorts_no_more_than_the_cap(sales):
    rows = c.chart(sales, _spec("bar", *SUM), max_categories=2).rows
    assert "TakeOrderedAndProject" in rows._jdf.queryExecution().executedPlan().toString()


def test_specs_survive_a_round_trip():
    spec = c.ChartSpec("bar", (c.Encoding("x", "a"), c.Encoding("y", "b", "avg")), {"top_n": 3}, "T")
    assert c.ChartSpec.from_dict(json.loads(json.dumps(spec.to_dict()))) == spec
    board = d.Dashboard("B", ("one",), ({"field": "a", "value": "1"},), "n")
    assert d.Dashboard.from_dict(json.loads(json.dumps(board.to_dict()))) == board
    report = d.Report("R", (d.ReportSection("dataset", "t", dataset="x", order_by=("a",)),), "n")
    assert d.Report.from_dict(json.loads(json.dumps(report.to_dict()))) == report


def test_dashboard_filters_replace_those_of_charts(sales):
    own = _spec("bar", *SUM, filters=[{"field": "region", "value": "A"}])
    charts = {"one": d.BoundChart(own, sales), "two": d.BoundChart(_spec("bar", *SUM), sales)}
    shared = ({"field": "region", "op": "neq", "value": "A"},)
    rows = d.dashboard_values(d.Dashboard("B", ("one", "two", "gone"), shared), charts).collect()
    assert Counter((r.widget, r.category) for r in rows) == Counter(
        [("one", "B"), ("one", "C"), ("two", "B"), ("two", "C")]
    )
    rows = d.dashboard_values(d.Dashboard("B", ("one",)), charts).collect()
    assert [r.category for r in rows] == ["A"]


def test_dashboard_sections_turn_bad_charts_into_text(spark, sales):
    charts = {
        "good": d.BoundChart(_spec("bar", *SUM), sales),
        "bad": d.BoundChart(_spec("scatter", ("x", "amount")), sales),
    }
    board = d.Dashboard("B", ("bad", "gone", "good"), ({"field": "region", "value": "C"},), "note")
    rows = d.dashboard_sections(spark, board, charts).orderBy("section_no", "row_no").collect()
    assert [(r.kind, r.title) for r in rows] == [
        ("heading", "B"), ("text", "Notes"), ("text", "bad"), ("chart", "good"),
    ]
    assert rows[2].payload.startswith("This chart could not be drawn:")
    assert json.loads(rows[3].payload) == {"category": "C", "value": 100.0}
    unlinked = d.dashboard_sections(spark, board, charts, apply_filters=False)
    assert unlinked.filter(F.col("kind") == "chart").count() == 3


def test_report_sections(spark, sales):
    many = spark.range(500).withColumnRenamed("id", "n")
    report = d.Report(
        "R",
        (
            d.ReportSection("heading", body="H"),
            d.ReportSection("notes", "N", "text"),
            d.ReportSection("chart"),
            d.ReportSection("dataset", dataset="many", order_by=("n",)),
            d.ReportSection("dataset", "first", dataset="many", order_by=("n",), rows=200),
            d.ReportSection("dataset"),
            d.ReportSection("other"),
        ),
    )
    rows = d.report_sections(spark, report, {}, {"many": many})
    texts = rows.filter(F.col("kind") != "table").orderBy("section_no").collect()
    assert [(r.kind, r.title, r.payload) for r in texts] == [
        ("heading", "R", None), ("heading", "H", None), ("text", "N", "text"),
        ("text", "Chart", "There is no such chart."),
        ("text", "", "A section of the kind 'other' cannot be shown."),
    ]
    tables = rows.filter(F.col("kind") == "table").orderBy("section_no", "row_no").collect()
    assert [json.loads(r.payload)["n"] for r in tables] == [*range(500), *range(200)]
    assert [r.row_no for r in tables] == [*range(1, 501), *range(1, 201)]
    bad = d.Report("R", (d.ReportSection("chart", chart="bad"),))
    charts = {"bad": d.BoundChart(_spec("bar"), sales)}
    with pytest.raises(RequestError):
        d.report_sections(spark, bad, charts, {})
