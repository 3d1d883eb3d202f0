"""Dashboards and reports: several chart and table results as one long table of sections.

A section row is ``(section_no, kind, title, row_no, payload)``; the payload of a data row is its
JSON text, of a text row the text itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions.columns import ORDINAL, col, require, select_all, visible
from tablewright.functions.values import as_double, as_text
from tablewright.operators.charts import ChartData, ChartSpec, Filter, chart, filtered, histogram
from tablewright.operators.paging import numbered

@dataclass(frozen=True)
class Dashboard:
    """A title, the names of its charts in order, shared filters and notes."""

    title: str
    charts: tuple[str, ...] = ()
    filters: tuple[Mapping[str, Any], ...] = ()
    notes: str = ""

    def to_dict(self) -> dict[str, Any]:
        return {
            "title": self.title,
            "charts": list(self.charts),
            "filters": [dict(f) for f in self.filters],
            "notes": self.notes,
        }

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Dashboard:
        return cls(
            str(data["title"]),
            tuple(data.get("charts") or ()),
            tuple(data.get("filters") or ()),
            str(data.get("notes") or ""),
        )


@dataclass(frozen=True)
class ReportSection:
    """One section: ``heading``, ``notes``, ``chart`` or ``dataset``.

    ``rows`` limits a dataset section to its first rows; without it all are listed.
    """

    kind: str
    title: str = ""
    body: str = ""
    chart: str | None = None
    dataset: str | None = None
    order_by: tuple[str, ...] = ()
    rows: int | None = None


@dataclass(frozen=True)
class Report:
    """A title, notes and sections."""

    title: str
    sections: tuple[ReportSection, ...] = ()
    notes: str = ""

    def to_dict(self) -> dict[str, Any]:
        return {
            "title": self.title,
            "notes": self.notes,
            "sections": [{**vars(s), "order_by": list(s.order_by)} for s in self.sections],
        }

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Report:
        return cls(
            str(data["title"]),
            tuple(
                ReportSection(**{**s, "order_by": tuple(s.get("order_by") or ())})
                for s in data.get("sections") or ()
            ),
            str(data.get("notes") or ""),
        )


@dataclass(frozen=True)
class BoundChart:
    """A chart together with the table it is drawn from."""

    spec: ChartSpec
    table: DataFrame
    order_by: tuple[str, ...] = field(default=())


def linked(spec: ChartSpec, filters: Sequence[Mapping[str, Any]]) -> ChartSpec:
    """The chart under a dashboard's filters, which take the place of its own unless empty."""
    if not filters:
        return spec
    return replace(spec, options={**spec.options, "filters": list(filters)})


def dashboard_charts(
    board: Dashboard, charts: Mapping[str, BoundChart]
) -> dict[str, ChartData]:
    """The data of every chart on a dashboard; names without a chart are left out."""
    return {
        name: chart(
            charts[name].table,
            linked(charts[name].spec, board.filters),
            order_by=charts[name].order_by,
        )
        for name in board.charts
        if name in charts
    }


def dashboard_values(board: Dashboard, charts: Mapping[str, BoundChart]) -> DataFrame:
    """All category charts of a dashboard in long form: ``widget``, ``category``, ``value``.

    Charts without series over the same table are drawn together, in one scan of it.
    """
    plain: dict[int, dict[str, BoundChart]] = {}
    parts = []
    for name in dict.fromkeys(n for n in board.charts if n in charts):
        bound = charts[name]
        spec = linked(bound.spec, board.filters)
        if _is_plain(spec):
            plain.setdefault(id(bound.table), {})[name] = replace(bound, spec=spec)
            continue
        data = chart(bound.table, spec, order_by=bound.order_by)
        if data.category_column:
            value = F.col("value").cast("double").alias("value")
            parts.append(data.rows.select(F.lit(name).alias("widget"), "category", value))
    parts += [values_together(next(iter(own.values())).table, {n: b.spec for n, b in own.items()}) for own in plain.values()]
    if not parts:
        raise RequestError("the dashboard has no category chart", code="no_chart")
    return reduce(DataFrame.unionByName, parts)


def _is_plain(spec: ChartSpec) -> bool:
    """Whether a chart shows one value per category."""
    return (
        spec.chart_type not in ("table", "histogram", "scatter")
        and spec.encoding("x") is not None
        and spec.encoding("series") is None
    )


def values_together(table: DataFrame, specs: Mapping[str, ChartSpec]) -> DataFrame:
    """The values of several category charts of one table, from one scan: ``widget``, ``category``, ``value``.

    Each row of the table is a row of every widget whose filters it meets, within the task, where
    the aggregates are combined before the shuffle.
    """
    own, totals = [], []
    for number, (_, spec) in enumerate(specs.items()):
        keep = reduce(lambda a, b: a & b, [f.test(table) for f in Filter.parse(spec.options.get("filters"))], F.lit(True))
        y = spec.encoding("y")
        counts = y is None or (y.aggregation or "").lower() == "count"
        own.append(
            F.when(
                keep,
                F.struct(
                    F.lit(number).alias("number"),
                    as_text(table, spec.encoding("x").field).alias("category"),
                    (F.lit(None).cast("double") if counts else as_double(table, y.field)).alias("value"),
                    (F.lit(True) if y is None else col(table, y.field).isNotNull()).alias("counted"),
                ),
            )
        )
        name = "count" if counts else (y.aggregation or "sum").lower()
        totals.append({"avg": "avg", "mean": "avg", "min": "min", "max": "max", "count": "count"}.get(name, "sum"))
    rows = table.select(F.inline(F.array_compact(F.array(*own))))
    combined = rows.groupBy("number", "category").agg(
        F.sum("value").alias("sum"),
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_if("counted").cast("double").alias("count"),
    )
    pick = lambda values: F.element_at(F.array(*values), F.col("number") + 1)
    return combined.select(
        pick([F.lit(n) for n in specs]).alias("widget"), "category", pick([F.col(t) for t in totals]).alias("value")
    )


# --- sections as rows -----------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """What one section shows: a text, or the rows of a table in an order."""

    kind: str
    title: str
    text: str | None = None
    table: DataFrame | None = None
    order_by: tuple[str, ...] = ()
    # Shown in place of a table without rows.
    when_empty: str | None = None


def section_rows(spark: SparkSession, blocks: Sequence[Block]) -> DataFrame:
    """All blocks, numbered from 1, as one table.  A table's rows are sorted over all tasks."""
    parts = []
    for number, block in enumerate(blocks, 1):
        rows = _text_row(spark, block.text) if block.table is None else _table_rows(block)
        head = [F.lit(x).alias(n) for x, n in ((number, "section_no"), (block.kind, "kind"), (block.title, "title"))]
        parts.append(rows.select(*head, "row_no", "payload"))
        if block.when_empty is not None:
            found = block.table.limit(1).agg(F.count(F.lit(1))).scalar()
            none = _text_row(spark, block.when_empty).filter(found == 0)
            parts.append(none.select(head[0], F.lit("text").alias("kind"), head[2], "row_no", "payload"))
    return reduce(DataFrame.unionByName, parts)


def _text_row(spark: SparkSession, text: str | None) -> DataFrame:
    return spark.range(1).select(
        F.lit(1).cast("bigint").alias("row_no"), F.lit(text).cast("string").alias("payload")
    )


def _table_rows(block: Block) -> DataFrame:
    df = block.table
    require(df, block.order_by)
    payload = F.to_json(F.struct(*select_all(visible(df))), {"ignoreNullFields": "false"})
    keys = [col(df, n).alias(f"k{i}") for i, n in enumerate(block.order_by)]
    rows = df.select(*keys, payload.alias("payload"))
    order = [F.col(f"k{i}").asc_nulls_last() for i in range(len(keys))] or [F.monotonically_increasing_id()]
    return numbered(rows, order, "row_no", first=1).select("row_no", "payload")


def _chart_block(title: str, bound: BoundChart, filters: Sequence[Mapping[str, Any]] = ()) -> Block:
    spec = linked(bound.spec, filters)
    if spec.chart_type == "histogram":
        # A field without numbers is only seen when the rows are read, so it must not raise there.
        field_ = (spec.encoding("x") or spec.encoding("y"))
        if field_ is None:
            raise RequestError("a histogram needs an x field", code="no_field")
        rows = histogram(filtered(bound.table, spec.options.get("filters")), field_.field, strict=False)
        return Block("chart", title, table=rows.drop("bin_id"), order_by=("category",), when_empty=_failed(f"no numbers in '{field_.field}'"))
    data = chart(bound.table, spec, order_by=bound.order_by).rows
    order = tuple(n for n in ("category", "series") if n in data.columns)
    return Block("chart", title, table=data, order_by=order or tuple(n for n in bound.order_by if n in data.columns))


def _failed(why: object) -> str:
    return f"This chart could not be drawn: {why}"


def dashboard_sections(
    spark: SparkSession,
    board: Dashboard,
    charts: Mapping[str, BoundChart],
    apply_filters: bool = True,
) -> DataFrame:
    """The title, the notes and one block of rows per chart.

    Names without a chart are left out.  A chart that cannot be drawn becomes a text saying why,
    and so does a histogram that turns out to have no numbers.  The charts show what the screen
    shows, under the dashboard's filters, unless ``apply_filters`` is off.
    """
    filters = board.filters if apply_filters else ()

    def drawn(name: str) -> Block:
        title = charts[name].spec.title or name
        try:
            return _chart_block(title, charts[name], filters)
        except RequestError as why:
            return Block("text", title, _failed(why))

    notes = [Block("text", "Notes", board.notes)] if board.notes else []
    shown = [drawn(name) for name in board.charts if name in charts]
    return section_rows(spark, [Block("heading", board.title), *notes, *shown])


_Lookup = Callable[[ReportSection, Mapping[str, BoundChart], Mapping[str, DataFrame]], Block | None]


def _report_chart(part: ReportSection, charts: Mapping[str, BoundChart], _: Any) -> Block:
    bound = charts.get(part.chart or "")
    if bound is None:
        return Block("text", part.title or "Chart", "There is no such chart.")
    return _chart_block(part.title or bound.spec.title, bound)


def _report_table(part: ReportSection, _: Any, datasets: Mapping[str, DataFrame]) -> Block | None:
    if part.dataset is None:
        return None
    if part.dataset not in datasets:
        raise RequestError(f"no such dataset: {part.dataset}", code="no_dataset")
    table = datasets[part.dataset]
    order = part.order_by or ((ORDINAL,) if ORDINAL in table.columns else ())
    if part.rows is not None:
        keys = [col(table, n).asc_nulls_last() for n in order]
        table = (table.orderBy(*keys) if keys else table).limit(part.rows)
    return Block("table", part.title or part.dataset, table=table, order_by=tuple(order))


# How each kind of report section is made; other kinds are shown as text.
SECTION_KINDS: dict[str, _Lookup] = {
    "heading": lambda part, *_: Block("heading", part.title or part.body),
    "notes": lambda part, *_: Block("text", part.title, part.body),
    "chart": _report_chart,
    "dataset": _report_table,
}


def report_sections(
    spark: SparkSession,
    report: Report,
    charts: Mapping[str, BoundChart],
    datasets: Mapping[str, DataFrame],
) -> DataFrame:
    """The sections of a report in order.

    A chart that does not exist becomes a text; a section of a kind that is not in SECTION_KINDS
    shows its body.  A dataset section that names no dataset is left out; a chart whose request
    cannot be met fails the report.
    """

    def other(part: ReportSection, *_: Any) -> Block:
        return Block("text", part.title, part.body or f"A section of the kind '{part.kind}' cannot be shown.")

    blocks = [Block("heading", report.title)]
    if report.notes:
        blocks.append(Block("text", "Notes", report.notes))
    made = (SECTION_KINDS.get(part.kind, other)(part, charts, datasets) for part in report.sections)
    return section_rows(spark, [*blocks, *(block for block in made if block is not None)])
