"""Running and moving aggregates that no large group makes one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import col, dtype, quoted, require, unused_name
from tablewright.operators.joins import as_number
from tablewright.operators.paging import numbered
from tablewright.workspace import written

#: Rows of a slice: what a task sorts at once, whatever the size of a group.
SLICE_ROWS = 100_000

# The aggregates a frame can have.
AGGREGATES = ("sum", "count", "avg", "min", "max")


def _aggregate(name: str, value: Column) -> Column:
    if name not in AGGREGATES:
        raise RequestError(f"'{name}' is none of {', '.join(AGGREGATES)}", code="no_aggregate")
    return {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}[name](value)


class _Placed:
    """A table whose rows are numbered by group and order, and the names of its columns."""

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> None:
        require(df, by)
        self.columns, self.by = df.columns, list(by)
        self.place, self.slice = (unused_name(df, n) for n in ("frame_place", "frame_slice"))
        self.keys = [quoted(n) for n in by]
        self.rows = numbered(df, [*[col(df, n) for n in by], *order], self.place)

    def shown(self, **new: Column) -> list[Column]:
        kept = [F.col(quoted(n)) for n in self.columns if n not in new]
        return [*kept, *[v.alias(n) for n, v in new.items()]]

    def same(self, *more: str) -> Column:
        """That rows ``a`` and ``b`` have the same group; null is a group like others."""
        tests = [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in [*self.keys, *map(quoted, more)]]
        out = F.lit(True)
        for test in tests:
            out = out & test
        return out


def running(
    df: DataFrame,
    value: str,
    name: str,
    order: Sequence[Column],
    by: Sequence[str] = (),
    aggregate: str = "sum",
    *,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` with ``name``: an aggregate of ``value`` over the rows of the group up to each row.

    Rows come by ``order``; of equal rows any is first.  Nulls are not counted; before the first value
    the aggregate is null, a count 0.

    Rows are sorted over all tasks and numbered; the aggregate runs within slices of the numbers, and each
    slice takes over what the ones before it in its group add up to.  So neither one group nor a
    table without groups is one task; the sums to be carried are one row per group and slice.
    """
    if slice_rows < 1:
        raise RequestError("a slice has one row at least", code="no_rows")
    require(df, [value])
    _aggregate(aggregate, F.lit(0))
    p = _Placed(df, by, order)
    number = F.floor(F.col(p.place) / slice_rows).alias(p.slice)
    rows = p.rows.select("*", number)
    v = F.col(quoted(value))
    so_far = Window.partitionBy(*p.keys, p.slice).orderBy(p.place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*p.keys).orderBy(p.slice).rowsBetween(Window.unboundedPreceding, -1)
    # An average is carried as sum and count.
    parts = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}
    used = ["sum", "count"] if aggregate == "avg" else [aggregate]
    own = {n: unused_name(df, f"frame_{n}") for n in used}
    ends = rows.groupBy(*p.keys, p.slice).agg(*[parts[n][0](v).alias(own[n]) for n in used])
    carried = ends.select(*p.keys, p.slice, *[parts[n][1](quoted(own[n])).over(earlier).alias(own[n]) for n in used])
    here = rows.select("*", *[parts[n][0](v).over(so_far).alias(f"{own[n]}_here") for n in used])
    joined = here.alias("a").join(carried.alias("b"), p.same(p.slice))

    def total(n: str) -> Column:
        mine, past = F.col(f"a.{own[n]}_here"), F.col(f"b.{own[n]}")
        if n in ("min", "max"):
            return (F.least if n == "min" else F.greatest)(mine, past)
        return F.when(mine.isNull(), past).otherwise(mine + F.coalesce(past, F.lit(0)))

    found = total("sum") / total("count") if aggregate == "avg" else total(aggregate)
    if aggregate == "avg":
        found = F.when(total("count") > 0, total("sum") / total("count"))
    return joined.select(*[F.col(f"a.{quoted(n)}") for n in p.columns if n != name], found.alias(name))


def moving_rows(
    df: DataFrame,
    value: str,
    name: str,
    order: Sequence[Column],
    by: Sequence[str] = (),
    aggregate: str = "sum",
    *,
    preceding: int,
    following: int = 0,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` with ``name``: an aggregate of ``value`` over so many rows before and after each row.

    Rows are numbered as in ``running``.  A slice of numbers also gets copies of the rows near its ends
    that its frames reach, so it is aggregated for itself; slices are at least as long as a frame.
    """
    if preceding < 0 or following < 0:
        raise RequestError("a frame reaches back and forward by whole numbers", code="frame")
    require(df, [value])
    size = max(slice_rows, preceding + following + 1)
    p = _Placed(df, by, order)
    place, own = F.col(p.place), unused_name(df, "frame_own")
    at = lambda x: F.floor(x / size)
    wanted = F.sequence(at(F.greatest(place - following, F.lit(0))), at(place + preceding))
    rows = p.rows.select("*", at(place).alias(own), F.explode(wanted).alias(p.slice))
    frame = Window.partitionBy(*p.keys, p.slice).orderBy(p.place).rowsBetween(-preceding, following)
    found = _aggregate(aggregate, F.col(quoted(value))).over(frame)
    shown = unused_name(df, "frame_value")
    rows = rows.withColumn(shown, found).filter(F.col(own) == F.col(p.slice))
    return rows.select(*p.shown(**{name: F.col(shown)}))


def moving_range(
    df: DataFrame,
    value: str,
    name: str,
    order: str,
    by: Sequence[str] = (),
    aggregate: str = "sum",
    *,
    preceding: float,
    slice_width: float | None = None,
) -> DataFrame:
    """``df`` with ``name``: an aggregate over the rows whose ``order`` is at most ``preceding`` less.

    ``order`` is a number or a time; a time's ``preceding`` is in microseconds.  Rows with equal order
    see each other.  Rows without an order are a frame of their own, as in SQL.

    The axis is cut into slices no wider than a frame, and each row is copied into the next slices that frames
    reach it from.  So a frame is the rows of its slice up to its own, and those copies that are not too far
    back: two running aggregates, whose cost grows with the rows and not with how many a frame holds.
    A group is as many tasks as it has slices.  ``slice_width`` is checked, but slices stay that narrow.
    """
    if preceding < 0 or (slice_width is not None and slice_width < preceding):
        raise RequestError("a slice is at least as wide as a frame", code="frame")
    require(df, [value, order, *by])
    _aggregate(aggregate, F.lit(0))
    names = ("axis", "from", "slice", "last", "alone", "part", "near", "here", "back", "value")
    axis, start, own, last, alone, part, near, here, back, shown = (unused_name(df, f"frame_{n}") for n in names)
    rows = df.withColumn(axis, as_number(df, order))
    x = F.col(axis)
    first, final, single, at, bound = _slices(x, rows.schema[axis].dataType, preceding)
    rows = rows.select("*", first.alias(own), final.alias(last), single.alias(alone), at.alias(start), bound.alias(near))
    wanted = F.when(F.col(last) > F.col(own), F.sequence(own, last)).otherwise(F.array(own))
    rows = rows.select("*", F.explode(wanted).alias(part))
    mine = F.col(own).eqNullSafe(F.col(part))
    kept = [  # copies carry no more than they must
        (F.when(mine, F.col(quoted(f.name))).alias(f.name) if f.nullable and f.name not in by else F.col(quoted(f.name)))
        for f in df.schema
    ]
    v = _summed(df, value, aggregate)
    rows = rows.select(
        *kept, axis, alone, part, mine.alias(own), F.when(mine, F.col(near)).otherwise(F.col(start)).alias(near),
        F.when(mine, v).alias(here), F.when(~mine, v).alias(back),
    )
    slices = Window.partitionBy(*[quoted(n) for n in by], part, alone)
    reach = (Window.unboundedPreceding, Window.currentRow)
    up, down = slices.orderBy(axis).rangeBetween(*reach), slices.orderBy(F.desc(near)).rangeBetween(*reach)

    def both(n: str) -> Column:
        new, old = _aggregate(n, F.col(here)).over(up), _aggregate(n, F.col(back)).over(down)
        if n in ("min", "max"):
            return (F.least if n == "min" else F.greatest)(new, old)
        return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(new + old)

    found = F.when(both("count") > 0, both("sum") / both("count")) if aggregate == "avg" else both(aggregate)
    kind = df.select(_aggregate(aggregate, F.col(quoted(value))).alias(shown)).schema[shown].dataType
    rows = rows.withColumn(shown, found.cast(kind)).filter(F.col(own))
    return rows.select(*[F.col(quoted(n)) for n in df.columns if n != name], F.col(shown).alias(name))


def _summed(df: DataFrame, value: str, aggregate: str) -> Column:
    """The value as averages add it up: whole numbers as doubles."""
    v = F.col(quoted(value))
    return v.cast("double") if aggregate == "avg" and isinstance(dtype(df, value), T.IntegralType) else v


def _slices(x: Column, kind: T.DataType, preceding: float) -> tuple[Column, Column, Column, Column, Column]:
    """A row's slice; the last one with frames that reach it; what sets it apart in its slice; its place among
    the copies of a slice; and the place from which on copies are in its own frame."""
    none = F.lit(None).cast(kind)
    if preceding == 0:  # frames are equal rows
        return F.lit(0), F.lit(0), x, x, x
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        # Slices are as wide as a frame: it ends at the same distance from the slice's beginning as it begins in the one before.
        whole = not isinstance(kind, T.DecimalType)
        if whole and preceding < 1:
            return _slices(x, kind, 0)
        width = F.lit(math.floor(preceding) if whole else Decimal(str(preceding)))
        x = x.cast("long") if whole else x
        rest = F.pmod(x, width)
        first = F.call_function("div", x, width) - F.when(x % width < 0, 1).otherwise(0)
        return first, first + 1, none, rest, rest
    # The frame begins at the rounded difference, as in SQL.  Slices by a power of two are exact; where numbers lie
    # further apart than a frame is long, as infinite ones do, frames are equal rows again.
    step = 2.0 ** -23 if isinstance(kind, T.FloatType) else 2.0 ** -52
    width = F.lit(2.0 ** (math.frexp(preceding)[1] - 1))
    far = F.isnan(x) | (F.abs(x.cast("double")) / width >= 16 / step)
    at = lambda y: F.floor(F.when(~far, y.cast("double")) / width)
    reached = x.cast("double") + F.lit(float(preceding)) + F.abs(x.cast("double")) * (2 * step)
    return at(x), at(reached), F.when(far, x), x, x - F.lit(float(preceding)).cast(kind)


def ntile(df: DataFrame, name: str, tiles: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``name``: each group's rows by ``order`` in ``tiles`` parts, from 1, the first ones one longer.

    Rows are numbered over all tasks; a group's size and first number, one row per group, say the rest.
    """
    if tiles < 1:
        raise RequestError("there is one tile at least", code="tiles")
    p = _Placed(df, by, order)
    first, size = (unused_name(df, n) for n in ("frame_first", "frame_size"))
    groups = written(
        p.rows.groupBy(*p.keys).agg(F.min(p.place).alias(first), F.count(F.lit(1)).alias(size)), "frame-groups"
    )
    joined = p.rows.alias("a").join(groups.alias("b"), p.same())
    at, total = F.col(f"a.{p.place}") - F.col(f"b.{first}"), F.col(f"b.{size}")
    short = F.floor(total / tiles)
    longer = total % tiles
    edge = longer * (short + 1)
    tile = F.when(at < edge, F.floor(at / (short + 1))).otherwise(longer + F.floor((at - edge) / F.greatest(short, F.lit(1))))
    return joined.select(*[F.col(f"a.{quoted(n)}") for n in p.columns if n != name], (tile + 1).cast("int").alias(name))
