"""Joins of two datasets by time and by interval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import dtype, quoted, require

#: Slices of time per shuffle partition, and the most there are.
SLICES_PER_PART = 2
MOST_SLICES = 512
#: How much wider the bins of a level are than those of the level below.
LEVEL_FACTOR = 8

_SUFFIX = "_right"


def _shown(left: DataFrame, right: DataFrame, hidden: Sequence[str] = ()) -> list[Column]:
    """All columns of ``l`` and those of ``r``, renamed where they clash."""
    taken = {n.lower() for n in left.columns}
    out = [F.col(f"l.{quoted(n)}").alias(n) for n in left.columns]
    for name in right.columns:
        if name in hidden:
            continue
        own = name
        while own.lower() in taken:
            own += _SUFFIX
        taken.add(own.lower())
        out.append(F.col(f"r.{quoted(name)}").alias(own))
    return out


def _keys(left: DataFrame, right: DataFrame, by: Sequence[tuple[str, str]]) -> None:
    require(left, [a for a, _ in by])
    require(right, [b for _, b in by])


def slice_number(value: Column, bounds: Sequence[Column]) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``, by halving."""
    if not bounds:
        return F.lit(0)

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < bounds[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(bounds))


def even_bounds(df: DataFrame, value: str, parts: int) -> list[Column]:
    """Values that divide the rows of ``df`` into about ``parts`` equal parts; ``parts`` values come to the driver."""
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    kind = dtype(df, value)
    found = df.agg(F.percentile_approx(value, shares, 10 * parts).cast("array<string>").alias("b")).first()["b"] or []
    unique = list(dict.fromkeys(found))
    return [F.lit(x).cast(kind) for x in unique]


def join_asof(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    by: Sequence[tuple[str, str]] = (),
    *,
    how: str = "left",
    exact: bool = True,
    tolerance: Column | None = None,
) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` that is not after it.

    ``on`` names the two times, ``by`` pairs of key columns that must be equal.  With ``exact`` off the
    row of ``right`` must be earlier; with a ``tolerance`` (what is added to its time) it must not be
    longer ago.  Of rows of ``right`` with equal keys and times the greatest is taken, by its columns in
    order.  Rows of ``left`` without a match, among them those with a null key or time, have
    nulls, or go with ``how="inner"``.  Columns of ``right`` that clash get the suffix ``_right``.

    Both sides are sorted together within slices of time that hold about equally many rows, so a key with
    a third of all rows is many tasks.  What a slice ends with is carried into the next ones of
    its key: one row per key and slice.
    """
    if how not in ("left", "inner"):
        raise RequestError(f"'{how}' is neither left nor inner", code="join_kind")
    _keys(left, right, by)
    require(left, [on[0]])
    require(right, [on[1]])
    keys = [f"k{i}" for i in range(len(by))]

    def side(df: DataFrame, time: str, own: Sequence[str], rank: int, name: str) -> DataFrame:
        whole = F.struct(*[F.col(quoted(n)) for n in df.columns])
        return df.select(
            *[F.col(quoted(n)).alias(k) for n, k in zip(own, keys, strict=True)],
            F.col(quoted(time)).alias("t"),
            F.lit(rank).alias("side"),
            whole.alias(name),
        )

    lefts = side(left, on[0], [a for a, _ in by], 1, "l")
    rights = side(right, on[1], [b for _, b in by], 0 if exact else 2, "r")
    known = reduce(and_, [F.col(k).isNotNull() for k in [*keys, "t"]])
    both = lefts.filter(known).unionByName(rights.filter(known), allowMissingColumns=True)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = even_bounds(both.select("t"), "t", min(SLICES_PER_PART * parts, MOST_SLICES))
    both = both.withColumn("slice", slice_number(F.col("t"), bounds))

    within = Window.partitionBy(*keys, "slice").orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("seen", F.last("r", ignorenulls=True).over(within)).filter(F.col("l").isNotNull())
    newest = F.max_by("r", F.when(F.col("r").isNotNull(), F.struct("t", "r")))
    ends = both.groupBy(*keys, "slice").agg(newest.alias("newest"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "slice", F.last("newest", ignorenulls=True).over(before).alias("carried"))
    found = seen.join(carried, [*keys, "slice"], "left").select("t", "l", F.coalesce("seen", "carried").alias("r"))
    if tolerance is not None:
        near = F.col(f"r.{quoted(on[1])}") + tolerance >= F.col("t")
        found = found.withColumn("r", F.when(near, F.col("r")))
    found = found.select("l", "r")
    if how == "inner":
        found = found.filter(F.col("r").isNotNull())
    else:
        found = found.unionByName(lefts.filter(~known).select("l"), allowMissingColumns=True)
    return found.select(*_shown(left, right, [b for _, b in by]))


def as_number(df: DataFrame, name: str) -> Column:
    """A number that is ordered like the column: microseconds for times, the value for numbers."""
    kind, value = dtype(df, name), F.col(quoted(name))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        day = F.unix_date(value.cast("date")).cast("long") * 86_400_000_000
        if isinstance(kind, T.DateType):
            return day
        seconds = F.hour(value) * 3600 + F.minute(value) * 60
        return day + seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
    if isinstance(kind, T.NumericType):
        return value
    raise RequestError(f"'{name}' is neither a number nor a time", code="not_ordered")


def join_interval(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    by: Sequence[tuple[str, str]] = (),
    *,
    closed: bool = True,
    width: float | None = None,
) -> DataFrame:
    """All pairs of rows whose intervals overlap and whose ``by`` columns are equal.

    A span names where an interval begins and ends; both may be the same column, for points.  Ends
    belong to intervals if they are ``closed``; else only the beginning does, and an interval that ends
    where it begins is that point.  Nulls, NaN and intervals that end before they begin match
    nothing.  Columns of ``right`` that clash get the suffix ``_right``.

    Each row goes to the bins that its interval meets, two at most, on the level whose bins are as
    wide as itself and on the wider levels that the other side has; pairs are compared on the wider
    level of the two, in the first bin they share, so each comes once.  A long interval thus is not
    copied to many small bins.  ``width``, of the smallest bins, is the median length of all intervals
    unless given.  One number and the levels in use, a few dozen at most, come to the driver.
    """
    _keys(left, right, by)
    sides = []
    for df, span, own, name in ((left, left_span, [a for a, _ in by], "l"), (right, right_span, [b for _, b in by], "r")):
        first, last = (as_number(df, n) for n in span)
        rows = df.select(
            F.struct(*[F.col(quoted(n)) for n in df.columns]).alias(name),
            *[F.col(quoted(n)).alias(f"k{i}") for i, n in enumerate(own)],
            first.alias(f"{name}_from"),
            last.alias(f"{name}_to"),
        )
        real = F.col(f"{name}_from") <= F.col(f"{name}_to")
        finite = reduce(and_, [F.abs(F.col(f"{name}_{x}")).cast("double") < float("inf") for x in ("from", "to")])
        sides.append(rows.filter(real & finite))
    lengths = [s.select((F.col(f"{n}_to") - F.col(f"{n}_from")).cast("double").alias("n")) for s, n in zip(sides, "lr", strict=True)]
    if width is None:
        positive = lengths[0].unionAll(lengths[1]).filter("n > 0")
        width = positive.agg(F.percentile_approx("n", 0.5)).first()[0] or 1.0
    if not width > 0:
        raise RequestError("bins must have a width", code="no_width")
    # The level is found by comparing, not by logarithms: an interval never exceeds its bins.
    widths = [width]
    longest = max(s.agg(F.max("n")).first()[0] or 0.0 for s in lengths)
    while widths[-1] < longest:
        widths.append(widths[-1] * LEVEL_FACTOR)
    level_of = lambda n: slice_number(-n, [F.lit(-w) for w in reversed(widths)])
    top = len(widths)
    sides = [
        s.withColumn(f"{n}_level", F.lit(top) - level_of((F.col(f"{n}_to") - F.col(f"{n}_from")).cast("double")))
        for s, n in zip(sides, "lr", strict=True)
    ]
    used = [sorted(r[0] for r in s.select(f"{n}_level").distinct().collect()) for s, n in zip(sides, "lr", strict=True)]

    def binned(rows: DataFrame, name: str, others: list[int]) -> DataFrame:
        own = F.col(f"{name}_level")
        levels = F.array_distinct(F.concat(F.array(own), F.filter(F.array(*map(F.lit, others)), lambda x: x > own)))
        rows = rows.select("*", F.explode(levels).alias("level"))
        wide = F.element_at(F.array(*[F.lit(float(w)) for w in widths]), F.col("level") + 1)
        at = lambda x: F.floor(F.col(f"{name}_{x}") / wide)
        return rows.withColumn(f"{name}_first", at("from")).select("*", F.explode(F.sequence(f"{name}_first", at("to"))).alias("bin"))

    keys = [f"k{i}" for i in range(len(by))]
    pairs = binned(sides[0], "l", used[1] or [0]).join(binned(sides[1], "r", used[0] or [0]), [*keys, "level", "bin"])
    start = F.greatest("l_from", "r_from")
    ends_after = lambda n: (
        start <= F.col(f"{n}_to")
        if closed
        else (start < F.col(f"{n}_to")) | ((start == F.col(f"{n}_from")) & (F.col(f"{n}_from") == F.col(f"{n}_to")))
    )
    once = (F.col("level") == F.greatest("l_level", "r_level")) & (F.col("bin") == F.greatest("l_first", "r_first"))
    return pairs.filter(once & ends_after("l") & ends_after("r")).select(*_shown(left, right))
