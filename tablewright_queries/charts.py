"""Chart and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import charts as c
from tablewright.plans.dashboard import BoundChart, Dashboard, dashboard_sections, dashboard_values
from tablewright_queries.registry import Tables, query


def _spec(kind: str, *fields: tuple[str, ...], **options: object) -> c.ChartSpec:
    return c.ChartSpec(kind, tuple(c.Encoding(*f) for f in fields), options)


def _rounded(rows: DataFrame, digits: int) -> DataFrame:
    return rows.withColumn("value", F.round("value", digits))


def _price_by_flag(t: Tables, aggregation: str | None, **options: object) -> DataFrame:
    y = ("y", "l_extendedprice", aggregation) if aggregation else ("y", "l_extendedprice")
    return c.chart(t.lineitem, _spec("bar", ("x", "l_returnflag"), y, **options)).rows


@query("""
    SELECT l_returnflag AS category, ROUND(SUM(l_extendedprice), 2) AS value
    FROM lineitem GROUP BY l_returnflag
""")
def chart_sum(t: Tables) -> DataFrame:
    return _rounded(_price_by_flag(t, None), 2)


@query("""
    SELECT l_returnflag AS category, ROUND(SUM(l_extendedprice), 2) AS value
    FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_returnflag
""")
def chart_sum_filtered(t: Tables) -> DataFrame:
    open_items = [{"field": "l_linestatus", "op": "eq", "value": "O"}]
    return _rounded(_price_by_flag(t, "sum", filters=open_items), 2)


@query("""
    SELECT l_returnflag AS category, ROUND(AVG(l_extendedprice), 4) AS value
    FROM lineitem GROUP BY l_returnflag
""")
def chart_avg(t: Tables) -> DataFrame:
    return _rounded(_price_by_flag(t, "mean"), 4)


@query("""
    SELECT l_returnflag AS category, MIN(l_extendedprice) AS value
    FROM lineitem GROUP BY l_returnflag
""")
def chart_min(t: Tables) -> DataFrame:
    return _price_by_flag(t, "min")


@query("""
    SELECT l_returnflag AS category, MAX(l_extendedprice) AS value
    FROM lineitem GROUP BY l_returnflag
""")
def chart_max(t: Tables) -> DataFrame:
    return _price_by_flag(t, "max")


@query("""
    SELECT o_orderstatus AS category, COUNT(*) AS value FROM orders GROUP BY o_orderstatus
""")
def chart_count_rows(t: Tables) -> DataFrame:
    return c.chart(t.orders, _spec("pie", ("x", "o_orderstatus"))).rows


@query("""
    SELECT o_orderstatus AS category, COUNT(NULLIF(o_orderpriority, '3-MEDIUM')) AS value
    FROM orders GROUP BY o_orderstatus
""")
def chart_count_field(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("rated", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
    return c.chart(orders, _spec("bar", ("x", "o_orderstatus"), ("y", "rated", "count"))).rows


@query("""
    SELECT l_returnflag AS category, l_linestatus AS series, ROUND(SUM(l_quantity), 2) AS value
    FROM lineitem GROUP BY 1, 2
""")
def chart_series(t: Tables) -> DataFrame:
    spec = _spec("bar", ("x", "l_returnflag"), ("y", "l_quantity"), ("series", "l_linestatus"))
    return _rounded(c.chart(t.lineitem, spec).rows, 2)


@query("""
    WITH counts AS (
      SELECT source AS category, lang AS series, COUNT(*) AS n FROM documents GROUP BY 1, 2
    )
    SELECT a.category, b.series, CAST(COALESCE(c.n, 0) AS DOUBLE) AS value
    FROM (SELECT DISTINCT category FROM counts) a
    CROSS JOIN (SELECT DISTINCT series FROM counts) b
    LEFT JOIN counts c ON c.category = a.category AND c.series = b.series
""")
def chart_series_dense(t: Tables) -> DataFrame:
    spec = _spec("bar", ("x", "source"), ("series", "lang"))
    return c.dense_series(c.chart(t.documents, spec).rows)


@query("""
    SELECT ROW_NUMBER() OVER (ORDER BY event_type) - 1 AS x, event_type AS category,
           ROUND(AVG(value), 4) AS y
    FROM events GROUP BY event_type
""")
def chart_line_points(t: Tables) -> DataFrame:
    spec = _spec("line", ("x", "event_type"), ("y", "value", "avg"))
    points = c.line_points(c.chart(t.events, spec).rows)
    return points.withColumn("y", F.round("y", 4))


def _histogram_sql(source: str, field: str) -> str:
    return f"""
        WITH numbers AS (SELECT CAST({field} AS DOUBLE) AS v FROM {source}),
        ends AS (SELECT MIN(v) AS a, MAX(v) AS z FROM numbers),
        slots AS (
          SELECT CASE WHEN a = z THEN 1
                 ELSE LEAST(20, GREATEST(1, 1 + CAST(FLOOR((v - a) / ((z - a) / 20.0)) AS INTEGER)))
                 END AS slot
          FROM numbers CROSS JOIN ends
        )
        SELECT CAST(slot AS VARCHAR) AS category, COUNT(*) AS value FROM slots GROUP BY slot
    """


@query(_histogram_sql("events", "value"))
def chart_histogram(t: Tables) -> DataFrame:
    return c.chart(t.events, _spec("histogram", ("x", "value"))).rows


@query(_histogram_sql("(SELECT * FROM events WHERE event_type = 'click')", "value"))
def chart_histogram_filtered(t: Tables) -> DataFrame:
    clicks = [{"field": "event_type", "op": "eq", "value": "click"}]
    return c.chart(t.events, _spec("histogram", ("x", "value"), filters=clicks)).rows


@query(_histogram_sql("lineitem", "l_quantity * 0 + 7"))
def chart_histogram_const(t: Tables) -> DataFrame:
    items = t.lineitem.withColumn("seven", F.col("l_quantity") * 0 + 7)
    return c.chart(items, _spec("histogram", ("x", "seven"))).rows


@query("""
    SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part
""")
def chart_scatter(t: Tables) -> DataFrame:
    spec = _spec("scatter", ("x", "p_size"), ("y", "p_retailprice"))
    return c.chart(t.part, spec, order_by=["p_partkey"]).rows


@query("SELECT * FROM orders")
def chart_table(t: Tables) -> DataFrame:
    return c.chart(t.orders, _spec("table"), order_by=["o_orderkey"]).rows


def _filtered_orders(t: Tables, *filters: tuple[str, str, str]) -> DataFrame:
    wanted = [dict(zip(("field", "op", "value"), f, strict=True)) for f in filters]
    return c.chart(t.orders, _spec("bar", ("x", "o_orderpriority"), filters=wanted)).rows


@query("""
    SELECT o_orderpriority AS category, COUNT(*) AS value
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def chart_filter_eq(t: Tables) -> DataFrame:
    return _filtered_orders(t, ("o_orderstatus", "eq", "F"))


@query("""
    SELECT o_orderpriority AS category, COUNT(*) AS value
    FROM orders WHERE CAST(o_orderstatus AS VARCHAR) <> 'F' GROUP BY 1
""")
def chart_filter_neq(t: Tables) -> DataFrame:
    return _filtered_orders(t, ("o_orderstatus", "neq", "F"))


@query("""
    SELECT p_brand AS category, COUNT(*) AS value FROM part WHERE p_name LIKE '%a_e%' GROUP BY 1
""")
def chart_filter_contains(t: Tables) -> DataFrame:
    some = [{"field": "p_name", "op": "contains", "value": "a_e"}]
    return c.chart(t.part, _spec("bar", ("x", "p_brand"), filters=some)).rows


@query("""
    SELECT o_orderpriority AS category, COUNT(*) AS value
    FROM orders
    WHERE CAST(o_orderstatus AS VARCHAR) <> 'P' AND CAST(o_orderdate AS VARCHAR) LIKE '%-05-%'
      AND CAST(o_custkey AS VARCHAR) LIKE '%7%'
    GROUP BY 1
""")
def chart_filter_and(t: Tables) -> DataFrame:
    return _filtered_orders(
        t,
        ("o_orderstatus", "neq", "P"),
        ("o_orderdate", "contains", "-05-"),
        ("o_custkey", "contains", "7"),
    )


@query("""
    SELECT o_orderpriority AS category, COUNT(*) AS value
    FROM orders WHERE CAST(o_orderdate AS VARCHAR) = '1996-05-01 00:00:00' GROUP BY 1
""")
def chart_filter_timestamp(t: Tables) -> DataFrame:
    return _filtered_orders(t, ("o_orderdate", "eq", "1996-05-01 00:00:00"))


@query("""
    SELECT l_linenumber::VARCHAR AS category, COUNT(*) AS value
    FROM lineitem WHERE CAST(l_discount AS VARCHAR) = '0.05' GROUP BY 1
""")
def chart_filter_double(t: Tables) -> DataFrame:
    five = [{"field": "l_discount", "op": "eq", "value": "0.05"}]
    return c.chart(t.lineitem, _spec("bar", ("x", "l_linenumber"), filters=five)).rows


@query("""
    SELECT CAST(NULLIF(o_orderdate, TIMESTAMP '1996-05-01') AS VARCHAR) AS category,
           ROUND(SUM(o_totalprice), 2) AS value
    FROM orders GROUP BY 1 ORDER BY 1 ASC NULLS LAST LIMIT 500
""")
def chart_capped(t: Tables) -> DataFrame:
    return _rounded(_by_date(t).rows, 2)


@query("""
    SELECT COUNT(*) >= 500 AS truncated
    FROM (SELECT DISTINCT NULLIF(o_orderdate, TIMESTAMP '1996-05-01') FROM orders LIMIT 500)
""")
def chart_truncated(t: Tables) -> DataFrame:
    return _by_date(t).truncated()


def _by_date(t: Tables) -> c.ChartData:
    skipped = F.lit("1996-05-01 00:00:00").cast("timestamp_ntz")
    orders = t.orders.withColumn("day", F.nullif("o_orderdate", skipped))
    return c.chart(
        orders,
        _spec("line", ("x", "day"), ("y", "o_totalprice")),
        max_categories=c.category_cap(10_000),
    )


@query("""
    SELECT CAST(c_nationkey AS VARCHAR) AS category, ROUND(AVG(c_acctbal), 4) AS value
    FROM customer GROUP BY 1 ORDER BY AVG(c_acctbal) DESC, 1 LIMIT 10
""")
def chart_top_n(t: Tables) -> DataFrame:
    spec = _spec(
        "bar", ("x", "c_nationkey"), ("y", "c_acctbal", "avg"), sort="Value ↓", top_n=10
    )
    return _rounded(c.chart(t.customer, spec, apply_options=True).rows, 4)


@query("""
    SELECT CAST(o_custkey AS VARCHAR) AS category, COUNT(*) AS value
    FROM orders GROUP BY 1
""")
def chart_sorted(t: Tables) -> DataFrame:
    spec = _spec("bar", ("x", "o_custkey"), sort="Category Z→A")
    return c.chart(t.orders, spec, apply_options=True).rows


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS category, o_orderstatus AS series, o_totalprice AS value
    FROM orders
""")
def chart_series_many(t: Tables) -> DataFrame:
    """A series chart with as many points as there are orders; none is cut."""
    spec = _spec("line", ("x", "o_orderkey"), ("series", "o_orderstatus"), ("y", "o_totalprice"))
    return c.chart(t.orders, spec).rows


@query("""
    SELECT ROW_NUMBER() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS x,
           CAST(o_custkey AS VARCHAR) AS category, COUNT(*)::DOUBLE AS y
    FROM orders GROUP BY 2
""")
def chart_line_points(t: Tables) -> DataFrame:
    """The points of a line over all customers that ordered."""
    return c.line_points(c.category_aggregate(t.orders, "o_custkey"))


_PARTLY_NULL = """
    (SELECT NULLIF(c_mktsegment, 'BUILDING') AS segment,
            CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS balance
     FROM customer)
"""


def _partly_null(t: Tables, choice: str) -> DataFrame:
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    customers = t.customer.select(
        F.nullif(segment, F.lit("BUILDING")).alias("segment"),
        F.when(segment != "MACHINERY", balance).alias("balance"),
    )
    spec = _spec("bar", ("x", "segment"), ("y", "balance"), null_handling=choice)
    return _rounded(c.chart(customers, spec, apply_options=True).rows, 2)


@query(f"""
    SELECT segment AS category, ROUND(COALESCE(SUM(balance), 0), 2) AS value
    FROM {_PARTLY_NULL} GROUP BY 1
""")
def chart_null_handling(t: Tables) -> DataFrame:
    return _partly_null(t, c.NULLS_AS_ZERO)


@query(f"""
    SELECT segment AS category, ROUND(SUM(balance), 2) AS value
    FROM {_PARTLY_NULL} WHERE segment IS NOT NULL GROUP BY 1 HAVING SUM(balance) IS NOT NULL
""")
def chart_nulls_skipped(t: Tables) -> DataFrame:
    return _partly_null(t, c.SKIP_NULLS)


def _board(t: Tables) -> tuple[Dashboard, dict[str, BoundChart]]:
    items = t.lineitem
    returned = ({"field": "l_returnflag", "op": "eq", "value": "R"},)
    own = [{"field": "l_linestatus", "op": "eq", "value": "O"}]
    charts = {
        "count": BoundChart(_spec("bar", ("x", "l_linestatus"), filters=own), items),
        "quantity": BoundChart(_spec("pie", ("x", "l_linenumber"), ("y", "l_quantity")), items),
        "spread": BoundChart(_spec("histogram", ("x", "l_quantity")), items),
    }
    board = Dashboard("Returns", ("count", "quantity", "missing", "spread"), returned, "All returns")
    return board, charts


_RETURNS = "(SELECT * FROM lineitem WHERE l_returnflag = 'R')"
_WIDGETS = f"""
    SELECT 'count' AS widget, l_linestatus AS category, COUNT(*)::DOUBLE AS value
    FROM {_RETURNS} GROUP BY 2
    UNION ALL
    SELECT 'quantity', l_linenumber::VARCHAR, SUM(l_quantity) FROM {_RETURNS} GROUP BY 2
    UNION ALL
    SELECT 'spread', category, value::DOUBLE FROM ({_histogram_sql(_RETURNS, "l_quantity")})
"""


@query(_WIDGETS)
def dashboard_filtered(t: Tables) -> DataFrame:
    """The dashboard's filter takes the place of the filter one of its charts has."""
    return dashboard_values(*_board(t))


@query(f"""
    WITH widgets AS ({_WIDGETS})
    SELECT 1 AS section_no, 'heading' AS kind, 'Returns' AS title, 1::BIGINT AS row_no,
           NULL::VARCHAR AS payload
    UNION ALL SELECT 2, 'text', 'Notes', 1, 'All returns'
    UNION ALL
    SELECT 3, 'chart', 'count', ROW_NUMBER() OVER (ORDER BY category),
           to_json({{'category': category, 'value': value::BIGINT}})::VARCHAR
    FROM widgets WHERE widget = 'count'
    UNION ALL
    SELECT 4, 'chart', 'spread', ROW_NUMBER() OVER (ORDER BY category),
           to_json({{'category': category, 'value': value::BIGINT}})::VARCHAR
    FROM widgets WHERE widget = 'spread'
""", name="dashboard_sections")
def _dashboard_sections(t: Tables) -> DataFrame:
    board, charts = _board(t)
    whole = Dashboard(board.title, ("count", "missing", "spread"), board.filters, board.notes)
    return dashboard_sections(t.spark, whole, charts)
