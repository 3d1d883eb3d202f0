"""Windows, sessions and duplicates of streams of events, with watermarks for late rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import col, dtype, quoted, require
from tablewright.operators.charts import Encoding, measure


def read_arriving(
    spark: SparkSession, folder: str, schema: T.StructType, form: str = "parquet", *, files_per_batch: int | None = None
) -> DataFrame:
    """The files of a folder, and those to come, as a stream.

    The schema is stated, as every stream's; ``files_per_batch`` bounds what a batch takes, so that a
    folder with a long past is taken in pieces.
    """
    reader = spark.readStream.schema(schema).format(form)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """``events`` with a watermark; a time without zone is read in the session's."""
    require(events, [time])
    if isinstance(dtype(events, time), T.TimestampNTZType):
        events = events.withColumn(time, F.col(quoted(time)).cast("timestamp"))
    if not isinstance(dtype(events, time), T.TimestampType):
        raise RequestError(f"'{time}' is no time", code="not_a_time")
    return events.withWatermark(time, late)


def _measures(events: DataFrame, measures: Mapping[str, tuple[str, str | None]]) -> list:
    if not measures:
        raise RequestError("groups need a measure", code="no_measure")
    return [
        measure(events, None if field is None else Encoding("y", field, how)).alias(name)
        for name, (how, field) in measures.items()
    ]


def windows(
    events: DataFrame,
    time: str,
    width: str,
    measures: Mapping[str, tuple[str, str | None]],
    by: Sequence[str] = (),
    *,
    slide: str | None = None,
    late: str = "1 hour",
) -> DataFrame:
    """Measures by window of time and ``by``: ``start``, ``end``, the columns and the measures.

    Windows are ``width`` long and begin every ``slide`` (``width`` unless given).  Rows older than the latest
    time seen less ``late`` are not counted any more, and the state of their windows is dropped.
    """
    events = _timed(events, time, late)
    window = F.window(col(events, time), width, slide or width)
    grouped = events.groupBy(window.alias("w"), *[col(events, n) for n in by]).agg(*_measures(events, measures))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[quoted(n) for n in (*by, *measures)])


def sessions(
    events: DataFrame,
    time: str,
    gap: str,
    measures: Mapping[str, tuple[str, str | None]],
    by: Sequence[str],
    *,
    late: str = "1 hour",
) -> DataFrame:
    """Measures by session: rows of ``by`` that follow each other in ``gap`` or less.

    The state is one row per open session, merged within the task before the shuffle; sessions
    that the watermark has passed are given out and forgotten.
    """
    events = _timed(events, time, late)
    spark = events.sparkSession
    merging = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    if spark.conf.get(merging) != "true":
        spark.conf.set(merging, "true")
    window = F.session_window(col(events, time), gap)
    grouped = events.groupBy(window.alias("w"), *[col(events, n) for n in by]).agg(*_measures(events, measures))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[quoted(n) for n in (*by, *measures)])


def first_of_each(events: DataFrame, time: str, keys: Sequence[str], *, late: str = "1 hour") -> DataFrame:
    """``events`` without rows whose ``keys`` came before; keys are forgotten once the watermark passes their time by ``late``."""
    events = _timed(events, time, late)
    require(events, keys)
    return events.dropDuplicatesWithinWatermark(list(keys))
