"""Groups of several kinds in one scan, and conditions on their measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions.columns import col, require
from tablewright.operators.charts import Encoding, measure
from tablewright.operators.cleaning import filter_rows

# What may be grouped together; a list of sets of columns is the third way.
KINDS = ("sets", "cube", "rollup", "plain")


def grouped(
    df: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, tuple[str, str | None]],
    kind: str = "plain",
    *,
    sets: Sequence[Sequence[str]] = (),
    having: Sequence[Mapping[str, Any]] = (),
) -> DataFrame:
    """Measures of the groups that ``by`` makes: ``plain``, as ``cube`` or ``rollup``, or of given ``sets``.

    ``measures`` maps a name to an aggregate and a field; without a field rows are counted.  Aggregates are
    those of charts.  Except for plain groups, ``grouping_id`` tells which columns a row sums over (the
    last column of ``by`` is the lowest bit), so their nulls are not mistaken for null values.  ``having``
    lists conditions ``column``, ``operator``, ``value`` on the result, as ``filter_rows`` takes them.

    All groupings come from one scan: Spark expands rows within the task and combines them before the
    shuffle.
    """
    if kind not in KINDS:
        raise RequestError(f"'{kind}' is none of {', '.join(KINDS)}", code="grouping")
    if not measures:
        raise RequestError("groups need a measure", code="no_measure")
    columns = [col(df, n) for n in by]
    if kind == "sets":
        for one in sets:
            require(df, one)
            if not set(one) <= set(by):
                raise RequestError("a grouping set has columns of the grouping", code="grouping")
        groups = df.groupingSets([[col(df, n) for n in one] for one in sets], *columns)
    else:
        groups = {"cube": df.cube, "rollup": df.rollup, "plain": df.groupBy}[kind](*columns)
    found = [
        measure(df, None if field is None else Encoding("y", field, how)).alias(name)
        for name, (how, field) in measures.items()
    ]
    if kind != "plain":
        found.insert(0, F.grouping_id().alias("grouping_id"))
    out = groups.agg(*found)
    for one in having:
        out = filter_rows(out, str(one["column"]), str(one.get("operator", "=")), one.get("value"))
    return out
