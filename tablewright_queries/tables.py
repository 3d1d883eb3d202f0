"""Queries over stored tables: counts, descriptions, pages, history and live SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import catalog, lineage, paging
from tablewright.operators.charts import ChartSpec, Encoding
from tablewright.plans.dashboard import BoundChart, Report, ReportSection, report_sections
from tablewright.sources import live
from tablewright.store.revisions import RevisionStore
from tablewright.workspace import new_folder
from tablewright_queries.registry import TABLES, Tables, query

_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {name}" for name in TABLES
)
_NAMES = ", ".join(f"'{name}'" for name in TABLES)


@query(_COUNTS)
def row_count(t: Tables) -> DataFrame:
    return catalog.row_counts(t.all())


@query(f"""
    SELECT c.table_name, c.column_name,
           CASE WHEN c.data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integer'
                WHEN c.data_type IN ('FLOAT', 'DOUBLE') OR c.data_type LIKE 'DECIMAL%' THEN 'float'
                WHEN c.data_type = 'BOOLEAN' THEN 'boolean'
                WHEN c.data_type IN ('DATE', 'TIMESTAMP') THEN 'datetime'
                WHEN c.data_type = 'BLOB' THEN 'binary'
                WHEN c.data_type = 'VARCHAR' THEN 'text'
                ELSE 'unknown' END AS logical_type,
           n.row_count
    FROM duckdb_columns() c JOIN ({_COUNTS}) n ON n.table_name = c.table_name
    WHERE c.table_name IN ({_NAMES})
""")
def describe_columns(t: Tables) -> DataFrame:
    """Every column of every table with its logical type and its table's row count."""
    tables = t.all()
    columns = catalog.describe_columns(t.spark, tables)
    return columns.join(catalog.row_counts(tables), "table_name").select(
        "table_name", "column_name", "logical_type", "row_count"
    )


@query("SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def page_sorted(t: Tables) -> DataFrame:
    return paging.sorted_page(t.orders, "o_totalprice", 100, 50, ties=["o_orderkey"])


@query("SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 500")
def page_desc(t: Tables) -> DataFrame:
    return paging.sorted_page(t.orders, "o_orderdate", descending=True, ties=["o_orderkey"])


@query("SELECT * FROM orders ORDER BY o_totalprice NULLS LAST, o_orderkey LIMIT 50 OFFSET 1400")
def page_deep(t: Tables) -> DataFrame:
    """A page beyond what one task should sort, narrowed down to by drawn keys."""
    return paging.sorted_page(
        t.orders, "o_totalprice", 1400, 50, ties=["o_orderkey"], top_rows=1000
    )


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1400")
def page_ordinal(t: Tables) -> DataFrame:
    """A page by order of arrival from a stored table."""
    store = RevisionStore(t.spark, new_folder(t.spark, "store"))
    return store.page(store.import_table(t.orders, "Orders").revision_id, 1400, 50)


@query("SELECT * FROM orders")
def src_import(t: Tables) -> DataFrame:
    store = RevisionStore(t.spark, new_folder(t.spark, "store"))
    return store.read(store.import_table(t.orders, "Orders").revision_id)


@query("""
    SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice)
    FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')
    UNION ALL
    SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
""")
def import_merge(t: Tables) -> DataFrame:
    """Orders in process get dearer, urgent open ones go, and urgent finished ones come a second time."""
    store = RevisionStore(t.spark, new_folder(t.spark, "store"))
    dataset = store.import_table(t.orders, "Orders", keys=["o_orderkey"], buckets=16).dataset_id
    status, urgent = F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT"
    dearer = t.orders.filter(status == "P").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    again = t.orders.filter((status == "F") & urgent).withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    gone = t.orders.filter((status == "O") & urgent)
    changes = dearer.unionByName(again).unionByName(gone)
    return store.read(
        store.import_merge(dataset, changes, ["o_orderkey"], delete="o_orderstatus = 'O'").revision_id
    )


@query("""
    SELECT conv_id || '/' || turn AS revision_id,
           CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent_id,
           conv_id || '/0' AS root_id, turn AS depth
    FROM conversations
""")
def revision_lineage(t: Tables) -> DataFrame:
    """Conversations read as histories: every turn is a revision of the turn before it."""
    key = F.concat_ws("/", F.col("conv_id"), F.col("turn"))
    parent = F.concat_ws("/", F.col("conv_id"), F.col("turn") - 1)
    revisions = t.conversations.select(
        key.alias("revision_id"), F.when(F.col("turn") > 0, parent).alias("parent_id")
    )
    return lineage.revision_lineage(revisions)


_LIVE = """
    SELECT n_name, count(*) AS order_count, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' GROUP BY n_name
"""


@query(_LIVE)
def live_query(t: Tables) -> DataFrame:
    live.expose({"orders": t.orders, "customer": t.customer, "nation": t.nation})
    return live.live_query(t.spark, _LIVE)


@query("""
    SELECT 1 AS section_no, 'heading' AS kind, 'Orders' AS title, 1::BIGINT AS row_no,
           NULL::VARCHAR AS payload
    UNION ALL SELECT 2, 'text', 'Notes', 1, 'Monthly'
    UNION ALL SELECT 3, 'heading', 'By status', 1, NULL
    UNION ALL
    SELECT 4, 'chart', 'Status', ROW_NUMBER() OVER (ORDER BY category),
           to_json({'category': category, 'value': value})::VARCHAR
    FROM (SELECT o_orderstatus AS category, COUNT(*) AS value FROM orders GROUP BY 1)
    UNION ALL SELECT 5, 'text', 'Gone', 1, 'There is no such chart.'
    UNION ALL
    SELECT 6, 'table', 'Labels', doc, to_json({'doc_id': doc_id, 'quality': quality, 'toxic': toxic})::VARCHAR
    FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY doc_id) AS doc FROM labels)
    UNION ALL
    SELECT 7, 'table', 'nation', n_nationkey + 1,
           to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR
    FROM nation
    UNION ALL SELECT 8, 'text', 'Odd', 1, 'A section of the kind ''map'' cannot be shown.'
""", name="report_sections")
def _report_sections(t: Tables) -> DataFrame:
    by_status = ChartSpec("bar", (Encoding("x", "o_orderstatus"),), title="Status")
    report = Report(
        "Orders",
        (
            ReportSection("heading", "By status"),
            ReportSection("chart", chart="status"),
            ReportSection("chart", "Gone", chart="gone"),
            ReportSection("dataset", "Labels", dataset="labels", order_by=("doc_id",)),
            ReportSection("dataset", dataset="nation", order_by=("n_nationkey",)),
            ReportSection("dataset", "Left out"),
            ReportSection("map", "Odd"),
        ),
        "Monthly",
    )
    datasets = {"labels": t.labels, "nation": t.nation}
    return report_sections(t.spark, report, {"status": BoundChart(by_status, t.orders)}, datasets)
