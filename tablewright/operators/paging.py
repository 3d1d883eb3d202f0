"""Pages of a table, by position or sorted by a column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ORDINAL, col, quoted, select_all, unused_name
from tablewright.workspace import written

# A sorted page is taken from the best rows of every task once no more than this many rows precede its end.
TOP_ROWS = 10_000

# Keys drawn to tell between which keys a page lies, and how far around their place the bounds are set,
# in square roots of these.
_SAMPLED = 4_096
_ROOM = 2.0

# A row id made by ``monotonically_increasing_id`` holds the task in its upper and the place within
# the task in its lower 33 bits.
_PLACE_BITS = 33


def with_ordinal(df: DataFrame) -> DataFrame:
    """Number the rows by task and place, growing in the order of the rows."""
    return df.withColumn(ORDINAL, F.monotonically_increasing_id())


def part_starts(df: DataFrame) -> DataFrame:
    """For each part of a stored table: ``part``, ``first`` row id, ``rows`` and the rows before it.

    One row per part file; the running sum over these is the only global order needed.
    """
    return with_starts(part_counts(df))


def part_counts(df: DataFrame, *by: str) -> DataFrame:
    """``part``, ``first`` row id and ``rows`` of each part, or of each run of ``by`` within a part."""
    part = F.shiftright(F.col(ORDINAL), _PLACE_BITS).cast("bigint").alias("part")
    return df.groupBy(part, *select_all(by)).agg(
        F.min(ORDINAL).alias("first"), F.count(F.lit(1)).alias("rows")
    )


def with_starts(counts: DataFrame) -> DataFrame:
    """Counts of parts, each with the number of rows before it."""
    before = F.sum("rows").over(Window.orderBy("first")) - F.col("rows")
    return counts.withColumn("start", before)


def next_part(counts: DataFrame) -> int:
    """The first row id of a part beyond all of ``counts``."""
    last = counts.agg(F.max(F.shiftright("first", _PLACE_BITS))).head()[0]
    return 0 if last is None else (last + 1) << _PLACE_BITS


def numbered(df: DataFrame, keys: Sequence[Column], name: str, first: int = 0) -> DataFrame:
    """``df`` with the place of each row in the order of ``keys`` as ``name``, from ``first`` on.

    The sorted rows are written once to the shared folder; then the counts of their parts, one row
    each, say where every part begins.  No task holds more than its own part.
    """
    if ORDINAL in df.columns:  # a stored table's own numbers stay what they are
        kept = unused_name(df, "kept_ordinal")
        renamed = df.orderBy(*keys).withColumnRenamed(ORDINAL, kept)
        return numbered(renamed, [], name, first).withColumnRenamed(kept, ORDINAL)
    copy = written(with_ordinal(df.orderBy(*keys) if keys else df), "numbered")
    part, start = unused_name(copy, "part"), unused_name(copy, "start")
    starts = part_starts(copy).select(F.col("part").alias(part), F.col("start").alias(start))
    place = F.col(ORDINAL) - F.shiftleft(F.col(part), _PLACE_BITS)
    return (
        copy.withColumn(part, F.shiftright(F.col(ORDINAL), _PLACE_BITS).cast("bigint"))
        .join(starts, part)
        .withColumn(name, (F.col(start) + place + first).cast("bigint"))
        .drop(part, start, ORDINAL)
    )


def first_rows(df: DataFrame, count: int) -> DataFrame:
    """``count`` rows of ``df``, those of its first parts, still in as many parts as they were.

    A plain limit would move all of them to one task.  The rows are written once to the shared
    folder, and a filter on their ids keeps the wanted ones.
    """
    if count <= 0:
        return df.limit(0)
    copy = written(with_ordinal(df.drop(ORDINAL)), "first-rows")
    last = _row_id(part_starts(copy), count - 1, clamp=True)
    # With fewer rows than that there is no such row, and all of them are wanted.
    return copy.filter(F.col(ORDINAL) <= F.coalesce(last, F.lit(2**63 - 1))).drop(ORDINAL)


def page_by_position(df: DataFrame, starts: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a stored table, in order of arrival.

    The part starts turn the two positions into two row ids, which reach the Parquet scan as a range
    filter.  A page in the middle of a large table costs a few row groups, however deep it lies.
    """
    if limit <= 0:
        return df.limit(0)
    first = _row_id(starts, offset)
    last = _row_id(starts, offset + limit - 1, clamp=True)
    place = F.col(ORDINAL)
    # The limit changes no row; it tells Spark that the page can be sorted in one place.
    return df.filter((place >= first) & (place <= last)).orderBy(ORDINAL).limit(limit)


def _row_id(starts: DataFrame, position: int, clamp: bool = False) -> Column:
    """The row id at a position; beyond the end NULL, or the last row id when clamped."""
    place = F.lit(position) - F.col("start")
    if clamp:
        place = F.least(place, F.col("rows") - 1)
    found = starts.filter((F.col("start") <= position) & (place < F.col("rows")))
    return found.agg(F.max(F.col("first") + place)).scalar()


def sorted_page(
    df: DataFrame,
    order_by: str,
    offset: int = 0,
    limit: int = 500,
    *,
    descending: bool = False,
    ties: Sequence[str] = (),
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by a column, NULL last both ways.

    ``ties`` orders rows that are equal in the column; stored tables fall back on arrival.

    A page far down is not found by sorting the table: the keys drawn at random say between which two
    keys it lies, the rows before these are counted, and only those between them, about a sixteenth, go
    on to the next round.  A table that is not stored is written once, unsorted, to number its rows.
    """
    if not ties and ORDINAL in df.columns:
        ties = [ORDINAL]
    if offset + limit <= top_rows:
        return df.orderBy(*_sides(df, order_by, ties, descending)).offset(offset).limit(limit)
    copy = df if ORDINAL in df.columns else written(with_ordinal(df), "numbered")
    ties = list(dict.fromkeys([*ties, ORDINAL]))
    row = unused_name(copy, "row")
    named = [order_by, *[n for n in ties if n != order_by]]
    narrow = copy.select(*[col(copy, n).alias(f"k{i}") for i, n in enumerate(named)], F.col(ORDINAL).alias("row"))
    left, skip, limit = _around_page(narrow, len(named), descending, offset, limit, top_rows)
    order = _sides(left, "k0", [f"k{i}" for i in range(1, len(named))], descending)
    if skip + limit <= top_rows:
        ids = left.orderBy(*order).offset(skip).limit(limit).select(F.col("row").alias(row))
        ids = F.broadcast(ids)  # ``top_rows`` at most
    else:
        placed = written(with_ordinal(left.orderBy(*order).select(F.col("row").alias(row))), "sorted-ids")
        ids = page_by_position(placed, part_starts(placed), skip, limit).select(row)
    found = copy.join(ids, F.col(ORDINAL) == F.col(row)).orderBy(*_sides(copy, order_by, ties, descending)).limit(limit)
    return found.select(*[F.col(quoted(n)) for n in df.columns if n != ORDINAL])


def _sides(df: DataFrame, order_by: str, ties: Sequence[str], descending: bool) -> list[Column]:
    c = col(df, order_by)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), *[col(df, n).asc_nulls_last() for n in ties]]


def _around_page(
    rows: DataFrame, keys: int, descending: bool, skip: int, limit: int, top_rows: int
) -> tuple[DataFrame, int, int]:
    """Fewer rows that hold a page, how many of them come before it, and how many it has.

    ``rows`` have the keys ``k0`` and so on, the last of which tells all of them apart, and ``row``.
    """
    n = rows.count()
    limit = max(min(limit, n - skip), 0)
    if not limit:
        return rows.limit(0), 0, 0
    names = [f"k{i}" for i in range(keys)]
    order = Window.orderBy(*_sides(rows, "k0", names[1:], descending))
    room, round_ = _ROOM, 0
    while skip + limit > top_rows:
        round_ += 1
        drawn = rows.orderBy(F.xxhash64("row", F.lit(round_)), "row").limit(_SAMPLED).select(*names)
        drawn = written(drawn.withColumn("place", F.row_number().over(order)), "drawn-keys")
        size = min(n, _SAMPLED)
        gap = room * math.sqrt(size)
        low, high = math.floor(skip / n * size - gap), math.ceil((skip + limit) / n * size + gap)
        if low < 1 and high > size:
            break  # the page is most of what is left
        zone = F.lit(1)
        if low >= 1:
            zone = F.when(_beyond(drawn, low, names, descending, before=True), 0).otherwise(zone)
        if high <= size:
            zone = F.when(_beyond(drawn, high, names, descending, before=False), 2).otherwise(zone)
        marked = rows.withColumn("zone", zone)
        counts = {r.zone: r["count"] for r in marked.groupBy("zone").count().collect()}
        before, inside = counts.get(0, 0), counts.get(1, 0)
        if before > skip or skip + limit > before + inside:
            room *= 2
            continue
        rows = written(marked.filter("zone = 1").drop("zone"), "page-candidates")
        shrunk, skip, n = inside <= 0.9 * n, skip - before, inside
        if not shrunk:
            break
    return rows, skip, limit


def _beyond(drawn: DataFrame, place: int, names: Sequence[str], descending: bool, before: bool) -> Column:
    """Whether a row's keys come before, or after, those drawn at a place; NULL is last."""
    bound = drawn.filter(F.col("place") == place)
    found = F.lit(False)
    for name in reversed(names):
        key, other = F.col(name), bound.agg(F.max(name)).scalar()
        smaller = before != (descending and name == names[0])
        passes = (key < other) if smaller else (key > other)
        apart = (key.isNotNull() & other.isNull()) if before else (key.isNull() & other.isNotNull())
        passes = F.coalesce(passes, F.lit(False)) | apart
        found = passes | (key.eqNullSafe(other) & found)
    return found
