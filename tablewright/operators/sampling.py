"""Uniform row samples of an exact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import require, select_all, unused_name, visible
from tablewright.functions.values import shuffle_key
from tablewright.operators.paging import numbered
from tablewright.workspace import written


def exact_sample(df: DataFrame, rows: int, keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``rows`` rows of ``df`` (all, if it has no more), every row being equally likely.

    A row's draw is a hash of ``keys`` (all columns, if there are none) and the seed, so a sample of
    a table with unique keys can be drawn again, anywhere.  Draws are counted by their first 16 bits, which
    tells up to where all rows are kept; only those at the edge are sorted, over all tasks, so no task
    holds more than its part of a sample of any size.  Rows that draw alike because their keys are
    equal are told apart by a second, random number.
    """
    require(df, keys)
    draw, tie = unused_name(df, "draw"), unused_name(df, "tie")
    parts = [F.coalesce(shuffle_key(df, n).cast("string"), F.lit("\0")) for n in keys or visible(df)]
    drawn = df.withColumn(draw, F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts)))
    if rows <= 0:
        return df.limit(0)
    range_ = F.substring(draw, 1, 4)
    counts = drawn.groupBy(range_.alias("range")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 rows at most
    counts = counts.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") >= rows)
    edge = counts.agg(F.min_by(F.struct("range", (F.lit(rows) - F.col("upto") + F.col("n")).alias("more")), "range").alias("edge")).first()["edge"]
    if edge is None:
        return df
    place = unused_name(df, "place")
    at_edge = drawn.filter(range_ == edge["range"]).withColumn(tie, F.rand(seed))
    some = numbered(at_edge, [F.col(draw), F.col(tie)], place).filter(F.col(place) < edge["more"])
    whole = drawn.filter(range_ < edge["range"])
    return written(whole.select(*select_all(df.columns)).unionAll(some.select(*select_all(df.columns))), "sample")
