"""Queries with functions of the user's own among the steps of a pipeline."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tablewright.operators.user_functions import (
    UserAggregate,
    register_aggregate,
    register_table_function,
)
from tablewright.plans.pipeline import CleaningPipeline
from tablewright_queries.registry import Tables, query


class SinceLike:
    """Microseconds since the last row of the partition with the same value in a column."""

    def __init__(self) -> None:
        self._last: dict = {}

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, like: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        fields = [T.StructField(n, kinds[n]) for n in (key.value, like.value)]
        return AnalyzeResult(T.StructType([*fields, T.StructField("micros", T.LongType())]))

    def eval(self, table: Row, key: str, time: str, like: str) -> Iterator[tuple]:
        kind, moment = table[like], table[time]
        before = self._last.get(kind)
        self._last[kind] = moment
        yield table[key], kind, None if before is None else (moment - before) // dt.timedelta(microseconds=1)


class LinesOf:
    """The lines of a text column, each beside the row's key."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        own = [T.StructField("line_no", T.LongType()), T.StructField("n_chars", T.LongType())]
        return AnalyzeResult(T.StructType([T.StructField(key.value, kinds[key.value]), *own]))

    def eval(self, table: Row, key: str, text: str) -> Iterator[tuple]:
        for number, line in enumerate((table[text] or "").split("\n"), 1):
            yield table[key], number, len(line)


def _squares(batch: pa.RecordBatch) -> dict:
    (values,) = batch.columns
    return {"n": len(values) - values.null_count, "total": pc.sum(pc.multiply(values, values)).as_py() or 0.0}


ROOT_MEAN_SQUARE = UserAggregate(
    "n bigint, total double",
    "double",
    _squares,
    lambda a, b: {"n": a["n"] + b["n"], "total": a["total"] + b["total"]},
    lambda state: (state["total"] / state["n"]) ** 0.5 if state["n"] else None,
)

register_table_function("since_like", SinceLike)
register_table_function("lines_of", LinesOf)
register_aggregate("root_mean_square", ROOT_MEAN_SQUARE)


def _replayed(*steps: tuple) -> CleaningPipeline:
    """A pipeline as a stored one comes back."""
    return CleaningPipeline.from_json(CleaningPipeline.of(*steps).to_json())


@query("""
    SELECT event_id, event_type AS kind,
           date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), ts) AS micros
    FROM events
""")
def step_udtf(t: Tables) -> DataFrame:
    """Time since a user's last event of the same type, by a table function over each user in order."""
    args = {"key": "event_id", "time": "ts", "like": "event_type"}
    steps = (
        ("since_like", {"args": args, "partition_by": ["user_id"], "order_by": ["ts", "event_id"]}),
        ("rename_column", {"from": "event_type", "to": "kind"}),
    )
    return _replayed(*steps).apply(t.events)


@query("""
    SELECT doc_id, line_no, length(line) AS n_chars
    FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
    WHERE length(line) > 0
""")
def step_udtf_lines(t: Tables) -> DataFrame:
    """The lines of all documents, by a table function that takes rows where they are."""
    steps = (
        ("lines_of", {"args": {"key": "doc_id", "text": "text"}}),
        ("filter_rows", {"column": "n_chars", "operator": ">", "value": 0}),
    )
    return _replayed(*steps).apply(t.documents)


@query("""
    SELECT l_returnflag, l_linestatus, round(sqrt(avg(l_extendedprice * l_extendedprice)), 4) AS rms
    FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2
""")
def step_udaf(t: Tables) -> DataFrame:
    """Root mean square of prices by two flags, between a filter and a change of name."""
    steps = (
        ("filter_rows", {"column": "l_quantity", "operator": ">", "value": 5}),
        ("root_mean_square", {"columns": ["l_extendedprice"], "by": ["l_returnflag", "l_linestatus"], "as": "r"}),
        ("rename_column", {"from": "r", "to": "rms"}),
    )
    return _replayed(*steps).apply(t.lineitem).withColumn("rms", F.round("rms", 4))
