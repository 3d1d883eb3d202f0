"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.workspace import written


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(id, root)`` for every id of ``links`` (columns ``a`` and ``b``, longs).

    ``root`` is the smallest id that links lead to.  Each round maps every id to the first of
    itself and its neighbours and draws the links between what is left.  First means the smallest
    id, which takes in a whole star at once, and every third round the smallest of hashes that the
    round salts anew, so that the graph also shrinks by a constant share however its ids are
    chained.  A round is one grouping (combined in the task, so a hub costs one row per task) and
    two joins on ids; it is written to the shared folder, which survives lost executors and cuts
    the lineage.  No links, ids or components pass through the driver.
    """
    links = written(links.filter("a <> b").select("a", "b"), "links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError("links did not contract")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = len(maps) % 3 == 2
        order = lambda name: F.xxhash64(name, F.lit(len(maps))) if drawn else F.lit(0).cast("long")  # noqa: B023, E731
        near = F.min(F.struct(order("b").alias("p"), F.col("b").alias("to")))
        own = F.struct(order("id").alias("p"), F.col("id").alias("to"))
        step = written(
            both.groupBy(F.col("a").alias("id"))
            .agg(near.alias("near"))
            .select("id", F.least("near", own)["to"].alias("to")),
            "step",
        )
        maps.append(step)
        links = written(
            links.join(step.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a")
            .join(step.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")),
            "links",
        )
    spark = links.sparkSession
    if not maps:
        return spark.createDataFrame([], "id long, root long")
    found = maps[-1]
    for step in reversed(maps[:-1]):
        found = (
            step.join(found.select(F.col("id").alias("to"), F.col("to").alias("last")), "to", "left")
            .select("id", F.coalesce("last", "to").alias("to"))
        )
    found = written(found, "roots")
    least = found.groupBy("to").agg(F.min("id").alias("root"))
    return found.join(least, "to").select("id", "root")
