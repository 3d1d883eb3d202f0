"""Joins by time and interval, frames, groupings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import frames, grouping, joins, sets
from tablewright.operators.charts import ChartSpec, Encoding
from tablewright.plans.dashboard import BoundChart, Dashboard, dashboard_values
from tablewright_queries.registry import Tables, query


@query("""
    SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, e.props, o.o_orderkey, o.o_orderstatus, o.o_totalprice,
           o.o_orderdate, o.o_orderpriority
    FROM events e ASOF LEFT JOIN (
      SELECT * FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1
    ) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate
""")
def join_asof(t: Tables) -> DataFrame:
    """Every event with the last order of its user."""
    return joins.join_asof(t.events, t.orders, ("ts", "o_orderdate"), [("user_id", "o_custkey")])


@query("""
    SELECT e.event_id, e.user_id, e.ts, p.event_id AS event_id_right, p.ts AS ts_right
    FROM events e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
      ON e.user_id = p.user_id AND e.ts > p.ts
    WHERE e.ts - p.ts <= INTERVAL 2 DAY
""")
def join_asof_within(t: Tables) -> DataFrame:
    """Events with the user's purchase before them, where that is at most two days ago."""
    bought = t.events.filter("event_type = 'purchase'")
    near = F.expr("INTERVAL '2' DAY")
    found = joins.join_asof(t.events, bought, ("ts", "ts"), [("user_id", "user_id")], how="inner", exact=False, tolerance=near)
    return found.select("event_id", "user_id", "ts", "event_id_right", "ts_right")


@query("""
    SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, l.l_orderkey, l.l_linenumber, l.l_shipdate
    FROM (SELECT *, o_orderdate + INTERVAL 2 DAY AS until FROM orders) o
    JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.until
""")
def join_interval(t: Tables) -> DataFrame:
    """Line items shipped within two days of their order."""
    orders = t.orders.withColumn("until", F.col("o_orderdate") + F.expr("INTERVAL '2' DAY"))
    found = joins.join_interval(orders, t.lineitem, ("o_orderdate", "until"), ("l_shipdate", "l_shipdate"), [("o_orderkey", "l_orderkey")])
    return found.select("o_orderkey", "o_custkey", "o_orderdate", "l_orderkey", "l_linenumber", "l_shipdate")


@query("""
    WITH spans AS (
      SELECT event_id, ts AS start, ts + (floor(value)::BIGINT + 1) * INTERVAL 1 SECOND AS until FROM events
    )
    SELECT a.event_id, b.event_id AS event_id_right FROM spans a JOIN spans b ON a.start < b.until AND b.start < a.until
""")
def join_interval_overlaps(t: Tables) -> DataFrame:
    """Pairs of events that overlap when each lasts as many whole seconds as exceed its value; there is no key."""
    long = F.make_dt_interval(secs=(F.floor("value") + 1).cast("decimal(18,6)"))
    spans = t.events.select("event_id", F.col("ts").alias("start"), (F.col("ts") + long).alias("until"))
    found = joins.join_interval(spans, spans, ("start", "until"), ("start", "until"), closed=False)
    return found.select("event_id", "event_id_right")


_RUNNING = """
    SELECT l_orderkey, l_linenumber, l_returnflag,
           SUM(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
                                 ROWS UNBOUNDED PRECEDING) AS so_far
    FROM lineitem
"""


def _line_order() -> list:
    return [F.col(n) for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]


@query(_RUNNING)
def window_running(t: Tables) -> DataFrame:
    """Quantities summed up by return flag: three groups, each a third of all rows."""
    found = frames.running(t.lineitem, "l_quantity", "so_far", _line_order(), ["l_returnflag"])
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", "so_far")


@query("""
    SELECT event_id, MAX(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS highest FROM events
""")
def window_running_global(t: Tables) -> DataFrame:
    """The highest value so far, over the whole table."""
    return frames.running(t.events, "value", "highest", [F.col("ts"), F.col("event_id")], aggregate="max").select("event_id", "highest")


@query("""
    SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 2 FOLLOWING), 6) AS around
    FROM events
""")
def window_moving(t: Tables) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    found = frames.moving_rows(t.events, "value", "around", order, ["event_type"], "avg", preceding=6, following=2)
    return found.select("event_id", F.round("around", 6).alias("around"))


@query("""
    SELECT event_id, COUNT(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent
    FROM events
""")
def window_moving_range(t: Tables) -> DataFrame:
    """Events of the same type in the six hours up to each event."""
    hours = 6 * 3600 * 1_000_000
    found = frames.moving_range(t.events, "value", "recent", "ts", ["event_type"], "count", preceding=hours)
    return found.select("event_id", "recent")


@query("""
    SELECT o_orderkey, NTILE(7) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS tile FROM orders
""")
def window_ntile(t: Tables) -> DataFrame:
    found = frames.ntile(t.orders, "tile", 7, [F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderstatus"])
    return found.select("o_orderkey", F.col("tile").cast("long"))


@query("""
    SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS grouping_id, COUNT(*) AS n_lines,
           ROUND(SUM(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def group_cube(t: Tables) -> DataFrame:
    measures = {"n_lines": ("count", None), "quantity": ("sum", "l_quantity")}
    found = grouping.grouped(t.lineitem, ["l_returnflag", "l_linestatus"], measures, "cube")
    return found.withColumn("quantity", F.round("quantity", 2))


@query("""
    SELECT o_orderstatus, o_orderpriority, GROUPING(o_orderstatus, o_orderpriority) AS grouping_id, MAX(o_totalprice) AS highest
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
""")
def group_sets(t: Tables) -> DataFrame:
    return grouping.grouped(
        t.orders, ["o_orderstatus", "o_orderpriority"], {"highest": ("max", "o_totalprice")}, "sets",
        sets=[["o_orderstatus"], ["o_orderpriority"], []],
    )


@query("""
    SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10
""")
def group_having(t: Tables) -> DataFrame:
    more = [{"column": "n_orders", "operator": ">", "value": 10}]
    return grouping.grouped(t.orders, ["o_custkey"], {"n_orders": ("count", None)}, having=more)


@query("""
    SELECT 'flags' AS widget, l_returnflag AS category, ROUND(SUM(l_extendedprice), 2) AS value
    FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL
    UNION ALL SELECT 'lines', l_linenumber::VARCHAR, COUNT(*)::DOUBLE FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL
    UNION ALL SELECT 'status', l_linestatus, MAX(l_quantity) FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL
    UNION ALL SELECT 'discounts', l_returnflag, ROUND(AVG(l_discount), 2) FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL
""")
def dashboard_one_scan(t: Tables) -> DataFrame:
    """Four widgets of one table, read once."""
    lines = t.lineitem
    widget = lambda *fields: BoundChart(ChartSpec("bar", tuple(Encoding(*f) for f in fields)), lines)
    charts = {
        "flags": widget(("x", "l_returnflag"), ("y", "l_extendedprice", "sum")),
        "lines": widget(("x", "l_linenumber")),
        "status": widget(("x", "l_linestatus"), ("y", "l_quantity", "max")),
        "discounts": widget(("x", "l_returnflag"), ("y", "l_discount", "avg")),
    }
    board = Dashboard("Lines", tuple(charts), ({"field": "l_linestatus", "op": "eq", "value": "O"},))
    return dashboard_values(board, charts).withColumn("value", F.round("value", 2))


@query("SELECT doc_id, lang, source FROM documents INTERSECT ALL SELECT doc_id // 2, lang, source FROM documents")
def set_intersect_all(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", "source")
    return sets.intersect_all(docs, docs.withColumn("doc_id", F.expr("doc_id div 2")))


@query("SELECT text, lang FROM documents EXCEPT ALL SELECT DISTINCT text, lang FROM documents")
def set_except_all(t: Tables) -> DataFrame:
    """Texts that come again, once for every repetition."""
    docs = t.documents.select("text", "lang")
    return sets.except_all(docs, docs.distinct())


@query("""
    WITH later AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
                          o_totalprice, o_orderdate, o_orderpriority FROM orders)
    SELECT 'removed' AS change, count(*) AS copies, * FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM later) GROUP BY ALL
    UNION ALL
    SELECT 'added', count(*), * FROM (SELECT * FROM later EXCEPT ALL SELECT * FROM orders) GROUP BY ALL
""")
def revision_diff(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus"))
    return sets.revision_diff(t.orders, t.orders.withColumn("o_orderstatus", status))
