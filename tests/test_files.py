"""Sources, sinks and live queries."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.sinks import tabular
from tablewright.sources import delimited, documents, live
from tablewright.sources.headers import normalised_names


def _file(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv(spark, tmp_path):
    df = delimited.read_delimited(spark, _file(tmp_path / "a.csv", "a,b\n1,x\n2,y\n"))
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (2, "y")]


def test_csv_types_nulls_and_bom(spark, tmp_path):
    text = (
        "﻿i,f,b,d,t,s,n,w\n"
        '1,1.5,true,2024-01-02,2024-01-02 03:04:05,"a, ""q""",NA,5d\n'
        "NA,2,false,,2024-01-03,NULL,,1\n"
    )
    df = delimited.read_delimited(spark, _file(tmp_path / "a.csv", text))
    assert df.dtypes == [
        ("i", "bigint"), ("f", "double"), ("b", "boolean"), ("d", "date"),
        ("t", "timestamp_ntz"), ("s", "string"), ("n", "string"), ("w", "string"),
    ]
    first, second = df.collect()
    assert tuple(first) == (
        1, 1.5, True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), 'a, "q"', None, "5d",
    )
    assert tuple(second)[:6] == (None, 2.0, False, None, dt.datetime(2024, 1, 3), None)


def test_csv_with_schema_fails_on_bad_cells(spark, tmp_path):
    path = _file(tmp_path / "a.csv", "a,b\n1,x\nz,y\n")
    assert delimited.read_delimited(spark, path).dtypes[0] == ("a", "string")
    with pytest.raises(Exception, match="not a bigint: z"):
        delimited.read_delimited(spark, path, schema="a bigint, b string").collect()
    with pytest.raises(Exception):  # noqa: B017 - a row with too few cells
        delimited.read_delimited(spark, _file(tmp_path / "b.csv", "a,b\n1\n")).collect()


def test_csv_headers(spark, tmp_path):
    df = delimited.read_delimited(spark, _file(tmp_path / "a.csv", "a,,a,a\n1,2,3,4\n"))
    assert df.columns == ["a", "col_1", "a_1", "a_2"]
    assert normalised_names(["x", None, "x", 3, "x", None]) == [
        "x", "col_1", "x_1", "3", "x_2", "col_5",
    ]


def test_csv_with_header_only(spark, tmp_path):
    df = delimited.read_delimited(spark, _file(tmp_path / "a.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a\tb\n", "\t"), ("abc\n", ","), ("", None),
        ("a;b,c\n", ","), ("a\tb,c\n", ","), ("a\tb;c;d\n", "\t"), ("a,b\r\nx;y;z;w\r\n", ";"),
        ("a" * 4095 + ",;;;", ";"), ("," + ";" * 2 + "x" * 5000 + "," * 50, ","),
        ("é" * 4095 + ";;;,,,,,", ","),
    ],
)
def test_delimiters(spark, tmp_path, text, expected):
    path = _file(tmp_path / "a.txt", text)
    found = [r.delimiter for r in delimited.detect_delimiters(spark, path).collect()]
    assert found == ([expected] if expected else [])


def test_files_are_matched_by_column_name(spark, tmp_path):
    _file(tmp_path / "a.csv", "a,b\n1,2\n")
    _file(tmp_path / "b.csv", "b;a\n10;20\n")
    df = delimited.read_delimited(spark, str(tmp_path))
    assert sorted((r.a, r.b) for r in df.collect()) == [(1, 2), (20, 10)]
    _file(tmp_path / "c.csv", "a,c\n1,2\n")
    with pytest.raises(RequestError):
        delimited.read_delimited(spark, str(tmp_path))


def test_delimiter_detection_has_no_window(spark, tmp_path):
    found = delimited.detect_delimiters(spark, _file(tmp_path / "a.csv", "a,b\n"))
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_delimiters_of_many_files(spark, tmp_path):
    for i, sign in enumerate([",", ";", "\t"] * 5):
        _file(tmp_path / f"{i:02d}.txt", f"a{sign}b\n1{sign}2\n")
    rows = delimited.detect_delimiters(spark, str(tmp_path)).orderBy("file").collect()
    assert [r.delimiter for r in rows] == [",", ";", "\t"] * 5


@pytest.mark.parametrize("key", ["data", "records", "items", "rows"])
def test_json_wrappers(spark, tmp_path, key):
    path = _file(tmp_path / "a.json", json.dumps({key: [{"a": 1, "b": "x"}, {"a": 2}], "n": 2}))
    assert [tuple(r) for r in documents.read_json(spark, path).collect()] == [(1, "x"), (2, None)]


def test_json_roots(spark, tmp_path):
    def read(value):
        return documents.read_json(spark, _file(tmp_path / "a.json", json.dumps(value)))

    assert [tuple(r) for r in read([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]).collect()] == [
        (1, "x"), (2, "y"),
    ]
    assert tuple(read({"a": 1, "data": 3}).head()) == (1, 3)
    assert read({"rows": [{"a": 1}], "data": [{"b": 2}]}).columns == ["b"]
    assert [r.value for r in read([1, 2, None, 4]).collect()] == [1, 2, None, 4]
    assert [r.value for r in read(["a", "b"]).collect()] == ["a", "b"]
    assert [r.value for r in read({"items": [1.5, 2.5]}).collect()] == [1.5, 2.5]
    # A field of a record in a root array is no list of records.
    kept = read([{"id": 1, "items": [{"a": 1}, {"a": 2}]}, {"id": 2, "items": []}])
    assert [(r.id, len(r["items"])) for r in kept.collect()] == [(1, 2), (2, 0)]
    mixed = sorted((r.a or 0, r.value or 0) for r in read([5, {"a": 1}]).collect())
    assert mixed == [(0, 5), (1, 0)]
    with pytest.raises(Exception, match="array or an object"):
        read("text").collect()


def test_json_files_are_unwrapped_one_by_one(spark, tmp_path):
    _file(tmp_path / "a.json", json.dumps({"data": [{"x": 1}]}))
    _file(tmp_path / "b.json", json.dumps([{"x": 2}, {"x": 3}]))
    assert sorted(r.x for r in documents.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_broken_json_fails(spark, tmp_path):
    path = _file(tmp_path / "a.json", '{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):  # noqa: B017, PT011
        documents.read_json(spark, path, lines=True).collect()


def test_json_flatten(spark, tmp_path):
    value = [{"a": 1, "n": {"x": "p", "y": {"z": True}}, "l": [1, 2]}]
    path = _file(tmp_path / "a.json", json.dumps(value))
    df = documents.read_json(spark, path)
    assert df.columns == ["a", "l", "n.x", "n.y.z"]
    assert tuple(df.head()) == (1, [1, 2], "p", True)
    assert documents.read_json(spark, path, flatten=False).columns == ["a", "l", "n"]


def test_json_lines(spark, tmp_path):
    path = _file(tmp_path / "a.json", '{"a": {"b": 1}}\n{"a": {"b": 2}}\n')
    df = documents.read_json(spark, path, lines=True)
    assert [r["a.b"] for r in df.collect()] == [1, 2]


def test_preview(spark):
    assert delimited.preview(spark.range(1000)).count() == 200
    assert delimited.preview(spark.range(1000), 3).count() == 3


@pytest.fixture
def table(spark):
    return spark.sql(
        """select * from values
           (1, 'a "q", b', 1.0E7D, timestamp_ntz '2024-01-02 03:04:05', date '2024-01-02'),
           (2, null, 0.5D, null, null) as t(i, s, d, t, day)"""
    )


def test_csv_export(spark, table, tmp_path):
    path = str(tmp_path / "out")
    tabular.write_csv(table, path)
    back = delimited.read_delimited(spark, path, delimiter=",")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in table.collect())
    assert any("10000000.0" in r.value for r in spark.read.text(path).collect())


def test_json_export(spark, table, tmp_path):
    path = str(tmp_path / "out")
    tabular.write_json(table, path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {"i": 2, "s": None, "d": 0.5, "t": None, "day": None} in lines
    assert {r["t"] for r in lines} == {"2024-01-02 03:04:05", None}


def test_export_caps(spark):
    df = spark.range(10).withColumn("_ordinal", F.col("id"))
    assert tabular.capped(df, 4).columns == ["id"] and tabular.capped(df, 4).count() == 4
    assert tabular.capped(df, None).count() == 10
    assert tuple(tabular.export_summary(df, 20).head()) == (10, False)
    assert tuple(tabular.export_summary(df, 10).head()) == (10, True)
    assert tuple(tabular.export_summary(df, 10, exact_truncation=True).head()) == (10, False)
    assert tuple(tabular.export_summary(df, 9, exact_truncation=True).head()) == (9, True)


def test_capped_export_stays_parallel(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8)
    tabular.write_csv(df, str(tmp_path / "all"))
    tabular.write_csv(df, str(tmp_path / "some"), cap=600)
    parts = [len(list((tmp_path / n).glob("part-*.csv"))) for n in ("all", "some")]
    assert parts[0] == 8 and parts[1] > 3
    back = delimited.read_delimited(spark, str(tmp_path / "some"), delimiter=",")
    assert sorted(r.id for r in back.collect()) == list(range(600))


def test_live_queries(spark):
    live.expose({"numbers": spark.range(10).withColumn("_ordinal", F.col("id"))})
    assert live.live_query(spark, "select * from numbers", 3).columns == ["id"]
    assert live.live_query(spark, "select * from numbers where id > 1", 3).count() == 3
    assert live.live_query(spark, "select sum(id) s from numbers").head().s == 45
    assert live.estimated_cost(spark, "select * from numbers") > 0
