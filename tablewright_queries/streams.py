"""Queries of streams: each takes in the given table through the file source, then reads what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.streaming import events as e
from tablewright.streaming.sinks import latest, take_in, taken
from tablewright.workspace import new_folder
from tablewright_queries.registry import Tables, query

_COUNT = {"n_events": ("count", None), "total": ("sum", "value")}


def _arriving(t: Tables) -> DataFrame:
    # A pattern, since the table is a file in some folders and a folder of files in others.
    return e.read_arriving(t.spark, f"{t.folder}/events.parque[t]", t.events.schema)


def _run(t: Tables, stream: DataFrame, mode: str) -> str:
    folder = new_folder(t.spark, "stream")
    take_in(stream, f"{folder}/rows", f"{folder}/checkpoint", mode)
    return f"{folder}/rows"


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("start", "end")}).withColumn("total", F.round("total", 2))


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS "end", event_type,
           COUNT(*) AS n_events, ROUND(SUM(value), 2) AS total
    FROM events GROUP BY ALL
""")
def stream_windows(t: Tables) -> DataFrame:
    """Events by type and six hours, taken in as a stream; windows that grow are written again."""
    stream = e.windows(_arriving(t), "ts", "6 hours", _COUNT, ["event_type"], late="40 days")
    folder = _run(t, stream, "update")
    return _plain(latest(t.spark, folder, stream.schema, ["start", "event_type"]))


@query("""
    WITH marked AS (
      SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true) AS fresh FROM events
    ), numbered AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM marked)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", COUNT(*) AS n_events, ROUND(SUM(value), 2) AS total
    FROM numbered GROUP BY user_id, number
""")
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions of users, which two hours without an event end.

    Sessions come in append mode, once they are closed; the watermark that a last event far ahead brings
    closes those that are open when the table ends.
    """
    stream = e.sessions(_arriving(t).unionByName(_closing(t)), "ts", "2 hours", _COUNT, ["user_id"], late="40 days")
    folder = _run(t, stream, "append")
    return _plain(taken(t.spark, folder, stream.schema)).filter(F.col("start") <= t.events.agg(F.max("ts")).scalar())


def _closing(t: Tables) -> DataFrame:
    """One more file for the stream: an event without a user, a year after the last one."""
    path = new_folder(t.spark, "stream-end")
    t.events.agg((F.max("ts") + F.expr("INTERVAL '400' DAY")).alias("ts")).write.parquet(path)
    last = e.read_arriving(t.spark, path, t.events.select("ts").schema)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in t.events.schema.fields if f.name != "ts"]
    return last.select("ts", *others).select(*t.events.columns)


@query("SELECT user_id, event_type, count(*) AS copies FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(t: Tables) -> DataFrame:
    """One event of every user and type."""
    stream = e.first_of_each(_arriving(t), "ts", ["user_id", "event_type"], late="40 days")
    folder = _run(t, stream, "append")
    rows = taken(t.spark, folder, stream.schema)
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("copies"))
