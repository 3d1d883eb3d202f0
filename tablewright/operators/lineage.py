"""Revision history: which revision came from which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.workspace import written


def revision_lineage(revisions: DataFrame, max_rounds: int = 64) -> DataFrame:
    """For every revision: ``revision_id``, ``parent_id``, its ``root_id`` and ``depth`` below it.

    Every revision points at an ancestor, at first its parent; each round replaces the pointer by
    the ancestor's own and so doubles the distance.  A history of n revisions takes log2(n) rounds
    of one equi-join on unique ids.  Rounds are written to the shared folder, which keeps the plan
    short and the work safe from lost executors.  A parent that does not exist makes a root.
    """
    ids = revisions.select(F.col("revision_id").alias("known"))
    start = revisions.join(ids, F.col("parent_id") == F.col("known"), "left").select(
        "revision_id",
        "parent_id",
        F.coalesce("known", "revision_id").alias("ancestor"),
        F.when(F.col("known").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"),
    )
    state = written(start, "lineage")
    done = state.filter("depth = 0")
    moving = state.filter("depth > 0")
    finished = moving.limit(0)
    for _ in range(max_rounds):
        if moving.isEmpty():
            return done.unionByName(finished).select(
                "revision_id", "parent_id", F.col("ancestor").alias("root_id"), "depth"
            )
        # Roots have nothing above them, so they never take part as the upper side; what points at
        # one is finished and never again takes part as the lower.
        above = moving.unionByName(finished).select(
            F.col("revision_id").alias("via"),
            F.col("ancestor").alias("next"),
            F.col("depth").alias("more"),
        )
        joined = moving.join(above, F.col("ancestor") == F.col("via"), "left")
        state = written(
            joined.select(
                "revision_id",
                "parent_id",
                F.coalesce("next", "ancestor").alias("ancestor"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("via").isNotNull().alias("moved"),
            ),
            "lineage",
        )
        finished = finished.unionByName(state.filter("not moved").drop("moved"))
        moving = state.filter("moved").drop("moved")
    raise RuntimeError("the revision history has a cycle")
