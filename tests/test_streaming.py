"""Streams: late rows, restarts, batches that run twice."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.streaming import events as e
from tablewright.streaming import sinks

_SCHEMA = "id long, ts timestamp_ntz, k string, v double"
_START = datetime(2024, 1, 1)
_MEASURES = {"n": ("count", None), "total": ("sum", "v")}


def _file(spark, folder, rows):
    made = [(i, _START + timedelta(minutes=m), k, float(i)) for i, m, k in rows]
    spark.createDataFrame(made, _SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _minutes(value):
    return int((value - _START).total_seconds() // 60)


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / n) for n in ("in", "out", "state")]


def test_windows_go_on_after_a_restart_and_leave_late_rows_out(spark, places):
    source, out, state = places
    stream = lambda: e.windows(e.read_arriving(spark, source, schema), "ts", "10 minutes", _MEASURES, ["k"], late="20 minutes")
    _file(spark, source, [(1, 0, "a"), (2, 9, "a"), (3, 12, "b")])
    schema = spark.read.parquet(source).schema
    assert sinks.take_in(stream(), out, state, "update") >= 1
    _file(spark, source, [(4, 5, "a"), (5, 200, "a")])
    sinks.take_in(stream(), out, state, "update")
    _file(spark, source, [(6, 6, "a"), (7, 205, None)])  # the first is late by now
    sinks.take_in(stream(), out, state, "update")
    assert sinks.take_in(stream(), out, state, "update") == 0
    found = sinks.latest(spark, out, stream().schema, ["start", "k"]).collect()
    assert sorted(((_minutes(r.start), r.k or "", r.n, r.total) for r in found)) == [
        (0, "a", 3, 7.0), (10, "b", 1, 3.0), (200, "", 1, 7.0), (200, "a", 1, 5.0),
    ]


def test_a_batch_that_fails_is_done_again_and_counts_once(spark, places, monkeypatch):
    source, out, state = places
    _file(spark, source, [(k, k, "a") for k in range(30)])
    schema = spark.read.parquet(source).schema
    rows = lambda: e.read_arriving(spark, source, schema)
    broken = rows().withColumn("id", F.when(F.col("id") == 29, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sinks.take_in(broken, out, state)
    assert sinks.take_in(rows(), out, state) == 1
    assert sorted(r.id for r in sinks.taken(spark, out, schema).collect()) == list(range(30))
    # The files of a batch that was written but not yet noted are replaced, not added to.
    again = spark.read.schema(schema).parquet(f"{out}/batch_id=0")
    assert again.count() == 30


def test_sessions_and_first_rows(spark, places):
    source, out, state = places
    _file(spark, source, [(1, 0, "a"), (2, 9, "a"), (3, 19, "a"), (4, 29, "b"), (5, 40, "a")])
    _file(spark, source, [(6, 5_000, None)])
    schema = spark.read.parquet(source).schema
    found = e.sessions(e.read_arriving(spark, source, schema), "ts", "10 minutes", _MEASURES, ["k"])
    sinks.take_in(found, out, state)
    rows = sinks.taken(spark, out, found.schema).collect()
    assert sorted((r.k, _minutes(r.start), _minutes(r.end), r.n) for r in rows) == [
        ("a", 0, 29, 3), ("a", 40, 50, 1), ("b", 29, 39, 1),
    ]
    first = e.first_of_each(e.read_arriving(spark, source, schema), "ts", ["k"], late="30 days")
    sinks.take_in(first, f"{out}-first", f"{state}-first")
    kept = sinks.taken(spark, f"{out}-first", first.schema).collect()
    assert sorted(r.k or "" for r in kept) == ["", "a", "b"]


def test_requests_that_cannot_be_met(spark, places):
    rows = spark.createDataFrame([(1, "x")], "id long, ts string")
    for bad in (
        lambda: e.windows(rows, "ts", "1 hour", _MEASURES),
        lambda: e.first_of_each(rows, "none", ["id"]),
        lambda: sinks.take_in(rows, *places[1:], "complete"),
        lambda: e.windows(rows.withColumn("ts", F.current_timestamp()), "ts", "1 hour", {}),
    ):
        with pytest.raises(RequestError):
            bad()
