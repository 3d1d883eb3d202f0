"""Writing a stream so that a batch that runs twice counts once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import quoted, require

_BATCH = "batch_id"


def take_in(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> int:
    """Write what has arrived and not been taken in yet, and return the number of batches.

    Every batch is a folder of its own, ``batch_id=n``, which it replaces: after a loss in the middle of a batch
    the stream does it again, with the same rows, and nothing is there twice.  ``checkpoint`` remembers how
    far the stream is and its state; a later call goes on from there.
    """
    if mode not in ("append", "update"):
        raise RequestError(f"'{mode}' is neither append nor update", code="stream_mode")
    done: list[int] = []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{_BATCH}={batch}")
        done.append(batch)

    started = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    )
    started.awaitTermination()
    return len(done)


def taken(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows that ``take_in`` wrote."""
    return spark.read.schema(schema).parquet(f"{folder}/{_BATCH}=*")


def latest(spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last row of every key that ``take_in`` wrote in update mode."""
    whole = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])
    rows = spark.read.schema(whole).option("basePath", folder).parquet(folder)
    require(rows, keys)
    # A batch gives a key once, so there is one row per key and batch to choose from.
    newest = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(F.desc(_BATCH))
    found = rows.withColumn("newest_first", F.row_number().over(newest)).filter("newest_first = 1")
    return found.select(*[quoted(f.name) for f in schema.fields])
