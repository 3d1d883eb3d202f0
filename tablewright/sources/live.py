"""Ad-hoc queries over named tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.columns import select_all, visible

_UNITS = {"B": 0, "KiB": 1, "MiB": 2, "GiB": 3, "TiB": 4, "PiB": 5, "EiB": 6}


def expose(tables: Mapping[str, DataFrame]) -> None:
    """Make tables queryable by name for the rest of the session."""
    for name, df in tables.items():
        df.select(*select_all(visible(df))).createOrReplaceTempView(name)


def live_query(spark: SparkSession, query: str, limit: int | None = None) -> DataFrame:
    """The result of a query over the exposed tables, capped when ``limit`` is given."""
    result = spark.sql(query)
    return result if limit is None else result.limit(limit)


def estimated_cost(spark: SparkSession, query: str) -> float | None:
    """Estimated size in bytes of a query's result, from the optimizer; nothing is run."""
    plan = spark.sql(f"EXPLAIN COST {query}").head()[0]
    found = re.search(r"Statistics\(sizeInBytes=([\d.E+]+)\s*([KMGTPE]iB|B)", plan)
    return float(found[1]) * 1024.0 ** _UNITS[found[2]] if found else None
