"""The data behind charts: filtered category, series, histogram, scatter and table queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions import values as v
from tablewright.functions.columns import col, require, select_all, visible
from tablewright.operators.paging import numbered

# The most categories a capped chart suggests, and the number of histogram bins.
MOST_CATEGORIES = 500
BINS = 20

#: Series a filled grid may have; more are refused, since every category gets all of them.
GRID_SERIES = 1_000


@dataclass(frozen=True)
class Encoding:
    """Which field plays which role (``x``, ``y`` or ``series``) in a chart."""

    role: str
    field: str
    aggregation: str | None = None


@dataclass(frozen=True)
class ChartSpec:
    """A chart: its type, its encodings and its options (``filters``, ``sort``, ...)."""

    chart_type: str
    encodings: tuple[Encoding, ...] = ()
    options: Mapping[str, Any] = field(default_factory=dict)
    title: str = ""

    def encoding(self, role: str) -> Encoding | None:
        return next((e for e in self.encodings if e.role == role), None)

    def to_dict(self) -> dict[str, Any]:
        return {
            "chart_type": self.chart_type,
            "title": self.title,
            "encodings": [vars(e) for e in self.encodings],
            "options": dict(self.options),
        }

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> ChartSpec:
        return cls(
            str(data["chart_type"]),
            tuple(Encoding(**e) for e in data.get("encodings", ())),
            dict(data.get("options") or {}),
            str(data.get("title", "")),
        )


@dataclass(frozen=True)
class ChartData:
    """A chart's rows, the columns to draw and the cap that was asked for, if any."""

    rows: DataFrame
    category_column: str | None
    value_columns: tuple[str, ...]
    cap: int | None = None

    def truncated(self) -> DataFrame:
        """One row saying whether the rows reached the cap; without a cap they never do."""
        if self.cap is None:
            return self.rows.sparkSession.range(1).select(F.lit(False).alias("truncated"))
        return self.rows.agg((F.count(F.lit(1)) >= self.cap).alias("truncated"))


def category_cap(max_points: int) -> int:
    """A cap on categories that suits a screen with a given number of points."""
    return min(MOST_CATEGORIES, max(50, max_points // 20))


def chart(
    df: DataFrame,
    spec: ChartSpec,
    *,
    max_points: int | None = None,
    max_categories: int | None = None,
    order_by: Sequence[str] = (),
    apply_options: bool = False,
) -> ChartData:
    """The data of one chart.  Nothing is computed until the rows are used.

    All rows are shown unless a cap is asked for: ``max_points`` for tables, scatter charts and
    series, ``max_categories`` for the rest but histograms, whose bins are few.  ``order_by``
    settles which rows a capped table or scatter chart shows.  The sort, top n and null handling
    choices stored with a chart take effect only with ``apply_options``.
    """
    rows = filtered(df, spec.options.get("filters"))
    x, y, series = (spec.encoding(role) for role in ("x", "y", "series"))
    if spec.chart_type == "table":
        names = tuple(visible(df))
        shown = _first(rows, max_points, order_by).select(*select_all(names))
        return ChartData(shown, None, names, max_points)
    if spec.chart_type == "histogram":
        if x is None and y is None:
            raise RequestError("a histogram needs an x field", code="no_field")
        shown = histogram(rows, (x or y).field).drop("bin_id")
        return ChartData(shown, "category", ("value",))
    if spec.chart_type == "scatter":
        if x is None or y is None:
            raise RequestError("a scatter chart needs x and y fields", code="no_field")
        points = scatter(rows, x.field, y.field, max_points, order_by)
        return ChartData(points, None, ("x", "y"), max_points)
    if x is None:
        raise RequestError("the chart needs an x field", code="no_field")
    if series is not None:
        shown = series_aggregate(rows, x.field, series.field, y, max_points)
        return ChartData(shown, "category", ("value",), max_points)
    shown = category_aggregate(rows, x.field, y, None if apply_options else max_categories)
    if apply_options:
        shown = _with_options(shown, spec.options, max_categories)
    return ChartData(shown, "category", ("value",), max_categories)


# --- filters ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    """A test of one field's text: equal to a value, different from it, or containing it."""

    field: str
    op: str
    value: Any

    @classmethod
    def parse(cls, stored: Any) -> tuple[Filter, ...]:
        """The filters of a chart's options; entries that are no objects are passed over."""
        if stored and not isinstance(stored, (list, tuple)):
            raise RequestError("a chart keeps its filters in a list", code="filter_form")
        parsed = (
            cls(str(f.get("field", "")), str(f.get("op", "eq")).lower(), f.get("value"))
            for f in stored or ()
            if isinstance(f, Mapping)
        )
        return tuple(f.checked() for f in parsed)

    def checked(self) -> Filter:
        if self.op not in _FILTER_TESTS:
            known = ", ".join(_FILTER_TESTS)
            raise RequestError(f"'{self.op}' is none of {known}", code="filter_op")
        return self

    def test(self, df: DataFrame) -> Column:
        return _FILTER_TESTS[self.op](df, self.field, self.value)


# The names of the three tests.
_FILTER_TESTS: dict[str, Callable[[DataFrame, str, Any], Column]] = {
    "eq": v.text_equals,
    "neq": lambda df, name, value: ~v.text_equals(df, name, value),
    "contains": lambda df, name, value: v.like(v.as_text(df, name), f"%{value}%"),
}


def filtered(df: DataFrame, filters: Any) -> DataFrame:
    """Keep the rows that meet all filters, each a dict of ``field``, ``op`` and ``value``."""
    for one in Filter.parse(filters):
        df = df.filter(one.test(df))
    return df


# --- aggregates ---------------------------------------------------------------------------


def measure(df: DataFrame, y: Encoding | None) -> Column:
    """The aggregate a chart draws; without a field it counts rows.  Unknown names mean sum."""
    if y is None:
        return F.count(F.lit(1))
    name = (y.aggregation or "sum").lower()
    if name == "count":
        return F.count(col(df, y.field))
    combine = {"avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max}.get(name, F.sum)
    return combine(v.as_double(df, y.field))


def category_aggregate(
    df: DataFrame, x: str, y: Encoding | None = None, cap: int | None = None
) -> DataFrame:
    """One value per category (``category``, ``value``), in category order, NULL last."""
    grouped = df.groupBy(v.as_text(df, x).alias("category")).agg(measure(df, y).alias("value"))
    return _up_to(grouped.orderBy(F.col("category").asc_nulls_last()), cap)


def series_aggregate(
    df: DataFrame, x: str, series: str, y: Encoding | None = None, cap: int | None = None
) -> DataFrame:
    """One value per category and series (``category``, ``series``, ``value``)."""
    grouped = (
        df.groupBy(v.as_text(df, x).alias("category"), v.as_text(df, series).alias("series"))
        .agg(measure(df, y).alias("value"))
        .orderBy(F.col("category").asc_nulls_last(), F.col("series").asc_nulls_last())
    )
    return _up_to(grouped, cap)


def _up_to(rows: DataFrame, cap: int | None) -> DataFrame:
    return rows if cap is None else rows.limit(cap)


def dense_series(rows: DataFrame, most: int = GRID_SERIES) -> DataFrame:
    """Fill a series result to a full grid: every category has every series, gaps are 0.

    NULL is drawn as the series ``None``; where there is a series of that text too, the value of
    NULL, which is drawn last, shows.  A grid grows with categories times series, so more than
    ``most`` series fail the query; their list travels as one value of that size at most.
    """
    label = F.coalesce(F.col("series"), F.lit("None"))
    last = F.max_by("value", F.col("series").isNull()).alias("value")
    labelled = rows.groupBy("category", label.alias("series")).agg(last)
    some = labelled.select("series").distinct().limit(most + 1)
    found = some.agg(F.array_sort(F.collect_list("series"))).scalar()
    all_series = F.when(F.size(found) <= most, found).otherwise(
        F.raise_error(F.lit(f"a grid of more than {most} series")).cast("array<string>")
    )
    grid = labelled.select("category").distinct().select("category", F.explode(all_series).alias("series"))
    return grid.alias("g").join(
        labelled.alias("v"),
        F.col("g.category").eqNullSafe(F.col("v.category")) & (F.col("g.series") == F.col("v.series")),
        "left",
    ).select("g.category", "g.series", F.coalesce(F.col("v.value").cast("double"), F.lit(0.0)).alias("value"))


def line_points(rows: DataFrame) -> DataFrame:
    """Points of a line or area chart: categories numbered from 0, NULL drawn as 0.

    Categories are sorted over all tasks and numbered part by part, so any number will do.
    """
    return numbered(rows, [F.col("category").asc_nulls_last()], "x").select(
        "x", "category", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("y")
    )


def histogram(df: DataFrame, x: str, bins: int = BINS, *, strict: bool = True) -> DataFrame:
    """Counts in equal-width bins from the least to the greatest value.

    Bins are numbered from 1; ``category`` is the number as text and orders as text, ``bin_id`` is
    the number.  Only occupied bins appear.  The bounds are a scalar subquery: one row, computed
    once and inlined as a constant, so the table is read twice.  A field without any finite number
    fails the query, or gives no row when ``strict`` is off.
    """
    if bins < 1:
        raise RequestError("a histogram needs at least one bin", code="bin_count")
    number = v.as_double(df, x)
    finite = df.select(number.alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf"))
    )
    ends = finite.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bounds = ends.select(F.struct("lo", "hi").alias("b")).scalar()
    low, high = bounds["lo"], bounds["hi"]
    width = (high - low) / F.lit(float(bins))
    slot = F.floor((F.col("v") - low) / width).cast("bigint") + 1
    bin_id = F.when(low == high, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.greatest(F.lit(1), slot))
    )
    counts = (
        finite.select(bin_id.cast("int").alias("bin_id"))
        .groupBy("bin_id")
        .agg(F.count(F.lit(1)).alias("value"))
        .select(F.col("bin_id").cast("string").alias("category"), "value", "bin_id")
    )
    if not strict:
        return counts.orderBy("category")
    # A row passes here only if there was no number, and then reading it fails the query.
    complaint = F.raise_error(F.lit(f"a histogram needs numbers in '{x}'"))
    check = (
        df.sparkSession.range(1)
        .filter(low.isNull())
        .select(
            complaint.cast("string").alias("category"),
            F.lit(0).cast("bigint").alias("value"),
            F.lit(0).alias("bin_id"),
        )
    )
    return counts.unionByName(check).orderBy("category")


def scatter(
    df: DataFrame, x: str, y: str, cap: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """The points that have a number in both fields, or the first of them."""
    both = df.filter(v.as_double(df, x).isNotNull() & v.as_double(df, y).isNotNull())
    return _first(both, cap, order_by).select(
        v.as_double(df, x).alias("x"), v.as_double(df, y).alias("y")
    )


def _first(df: DataFrame, cap: int | None, order_by: Sequence[str]) -> DataFrame:
    require(df, order_by)
    keys = [col(df, name).asc_nulls_last() for name in order_by]
    return _up_to(df.orderBy(*keys) if keys else df, cap)


# --- sort, top n and null options ------------------------------------------------------------

# The sort and null handling choices a chart's options may hold.
SORTS: dict[str, tuple[str, bool]] = {
    "Category A→Z": ("category", False),
    "Category Z→A": ("category", True),
    "Value ↑": ("value", False),
    "Value ↓": ("value", True),
}
SKIP_NULLS = "Skip nulls"
NULLS_AS_ZERO = "Treat as zero"


def handle_nulls(rows: DataFrame, choice: str | None) -> DataFrame:
    """Leave NULL categories and values out, draw NULL values as zero, or keep both as they are."""
    if choice == SKIP_NULLS:
        return rows.filter(F.col("category").isNotNull() & F.col("value").isNotNull())
    if choice == NULLS_AS_ZERO:
        return rows.withColumn("value", F.coalesce("value", F.lit(0)))
    return rows


def arranged(rows: DataFrame, sort: str | None, cap: int | None = None) -> DataFrame:
    """Sort a category result as chosen (by category unless told otherwise) and cap it if asked."""
    key, descending = SORTS.get(sort or "", ("category", False))
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    ties = [] if key == "category" else [F.col("category").asc_nulls_last()]
    return _up_to(rows.orderBy(first, *ties), cap)


def _with_options(rows: DataFrame, options: Mapping[str, Any], cap: int | None) -> DataFrame:
    top = int(options.get("top_n") or 0)
    rows = handle_nulls(rows, options.get("null_handling"))
    caps = [n for n in (cap, top) if n]
    return arranged(rows, options.get("sort"), min(caps, default=None))
