"""Shared folder for intermediate tables.

Everything the package parks between jobs goes below the folder the cluster names in
``spark.checkpoint.dir``, which every executor can reach.  Only when the session names none
(local runs, tests) is a temporary folder made and registered for the rest of the session.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``persist`` this survives the loss of executors, and later readers still prune
    columns and push filters.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers_find_library(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it.

    A cluster has it installed; this is for sessions that were started in another folder.
    """
    here = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if here not in known.split(":"):
        environment["PYTHONPATH"] = f"{here}:{known}" if known else here
