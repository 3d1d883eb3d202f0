"""Profiling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import catalog, profiling, sketches
from tablewright.operators.sampling import exact_sample
from tablewright.plans.profile import profile_report
from tablewright.store.revisions import RevisionStore
from tablewright.workspace import new_folder
from tablewright_queries.registry import TABLES, Tables, query


def _column_sql(table: str, column: str, numeric: bool) -> str:
    """The profile of one column."""
    far = (
        f"""(SELECT COUNT(*) FROM {table},
               (SELECT AVG({column}) AS m, STDDEV_SAMP({column}) AS s FROM {table})
             WHERE s > 0 AND ABS({column} - m) > 3 * s)"""
        if numeric
        else "0::BIGINT"
    )
    return f"""
        SELECT '{column}' AS column_name, COUNT(*) AS row_count,
               COUNT(*) - COUNT({column}) AS null_count,
               ROUND((COUNT(*) - COUNT({column})) / GREATEST(COUNT(*), 1), 6) AS null_ratio,
               COUNT(DISTINCT {column}) AS distinct_count,
               COUNT(*) = COUNT({column}) AND COUNT(DISTINCT {column}) = COUNT(*)
                 AND COUNT(*) > 0 AS is_candidate_key,
               CAST(MIN({column}) AS VARCHAR) AS min_value,
               CAST(MAX({column}) AS VARCHAR) AS max_value,
               {far} AS outlier_count
        FROM {table}
    """


def _profile_sql(table: str, columns: dict[str, bool]) -> str:
    return " UNION ALL ".join(_column_sql(table, c, numeric) for c, numeric in columns.items())


_EVENTS = {
    "event_id": True,
    "ts": False,
    "user_id": True,
    "event_type": False,
    "value": True,
    "props": False,
}
_CUSTOMER = {
    "c_custkey": True,
    "c_name": False,
    "c_nationkey": True,
    "c_acctbal": True,
    "c_mktsegment": False,
}
_LINEITEM = {
    "l_orderkey": True,
    "l_partkey": True,
    "l_suppkey": True,
    "l_linenumber": True,
    "l_quantity": True,
    "l_extendedprice": True,
    "l_discount": True,
    "l_tax": True,
    "l_returnflag": False,
    "l_linestatus": False,
    "l_shipdate": False,
}
_ORDERS = {
    "o_orderkey": True,
    "o_custkey": True,
    "o_orderstatus": False,
    "o_totalprice": True,
    "o_orderdate": False,
    "o_orderpriority": False,
}
_DOCUMENTS = {"doc_id": True, "text": False, "lang": False, "source": False, "n_chars": True}


def _columns(df: DataFrame) -> DataFrame:
    return (
        profiling.profile_columns(df)
        .drop("position")
        .withColumn("null_ratio", F.round("null_ratio", 6))
    )


_SOME_NULL = "(SELECT * REPLACE (NULLIF(event_type, 'error') AS event_type) FROM events)"


@query(_profile_sql(_SOME_NULL, _EVENTS))
def profile_columns(t: Tables) -> DataFrame:
    return _columns(t.events.withColumn("event_type", F.nullif("event_type", F.lit("error"))))


@query(_profile_sql("lineitem", _LINEITEM))
def profile_columns_wide(t: Tables) -> DataFrame:
    """A full profile of the largest table, never sampled."""
    return _columns(t.lineitem)


@query(_profile_sql("documents", _DOCUMENTS))
def profile_columns_text(t: Tables) -> DataFrame:
    """Long texts are counted by digest, so whole texts are compared but not shuffled."""
    return _columns(t.documents)


@query(" UNION ALL ".join(
    f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
               COUNT(*) > 0 AND COUNT({column}) = COUNT(*)
                 AND COUNT(DISTINCT {column}) = COUNT(*) AS is_candidate_key
        FROM {table}"""
    for table, columns in (("customer", _CUSTOMER), ("lineitem", _LINEITEM))
    for column in columns
))
def profile_keys(t: Tables) -> DataFrame:
    parts = [
        profiling.profile_columns(df, outliers=False).select(
            F.lit(name).alias("table_name"), "column_name", "is_candidate_key"
        )
        for name, df in (("customer", t.customer), ("lineitem", t.lineitem))
    ]
    return reduce(DataFrame.unionByName, parts)


@query(" UNION ALL ".join(
    f"""SELECT '{column}' AS column_name, COUNT(*) AS outlier_count
        FROM {table}, (SELECT AVG({column}) AS m, STDDEV_SAMP({column}) AS s FROM {table})
        WHERE s > 0 AND ABS({column} - m) > 3 * s"""
    for table, columns in (("events", _EVENTS), ("lineitem", _LINEITEM))
    for column, numeric in columns.items()
    if numeric
))
def profile_outliers(t: Tables) -> DataFrame:
    return profiling.outlier_counts(t.events).unionByName(profiling.outlier_counts(t.lineitem))


_RATED = "(SELECT * REPLACE (NULLIF(o_orderpriority, '3-MEDIUM') AS o_orderpriority) FROM orders)"


@query(" UNION ALL ".join(
    f"""(SELECT '{column}' AS column_name,
               CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) AS INTEGER) AS sample_no,
               CAST({column} AS VARCHAR) AS sample_value
        FROM {_RATED} WHERE {column} IS NOT NULL ORDER BY o_orderkey LIMIT 5)"""
    for column in (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
))
def profile_samples(t: Tables) -> DataFrame:
    rated = t.orders.withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    )
    return profiling.sample_values(rated, order_by="o_orderkey")


@query("""
    SELECT 'documents' AS table_name,
           COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM documents))
             AS duplicate_count
    FROM documents
    UNION ALL
    SELECT 'lineitem',
           COUNT(*) - (SELECT COUNT(*) FROM (
             SELECT DISTINCT * FROM lineitem))
    FROM lineitem
    UNION ALL
    SELECT 'orders', COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM orders)) FROM orders
""")
def profile_duplicates(t: Tables) -> DataFrame:
    tables = {
        "documents": t.documents,
        "lineitem": t.lineitem,
        "orders": t.orders,
    }
    parts = [
        profiling.duplicate_rows(df).select(F.lit(name).alias("table_name"), "duplicate_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {name}" for name in TABLES
)
_NAMES = ", ".join(f"'{name}'" for name in TABLES)


@query(f"""
    WITH named AS (
      SELECT DISTINCT table_name, LOWER(column_name) AS name
      FROM duckdb_columns() WHERE table_name IN ({_NAMES})
    ), counts AS ({_COUNTS})
    SELECT a.table_name AS left_table, b.table_name AS right_table,
           STRING_AGG(a.name, ', ' ORDER BY a.name) AS shared_columns,
           MIN(l.row_count) AS left_rows, MIN(r.row_count) AS right_rows
    FROM named a JOIN named b ON a.name = b.name AND a.table_name <> b.table_name
    JOIN counts l ON l.table_name = a.table_name JOIN counts r ON r.table_name = b.table_name
    GROUP BY 1, 2
""")
def profile_relationships(t: Tables) -> DataFrame:
    """Tables with columns in common, with the row counts of both sides."""
    tables = t.all()
    hints = catalog.relationship_hints(catalog.describe_columns(t.spark, tables))
    counts = catalog.row_counts(tables)
    left = counts.select(F.col("table_name").alias("left_table"), F.col("row_count").alias("left_rows"))
    right = counts.select(
        F.col("table_name").alias("right_table"), F.col("row_count").alias("right_rows")
    )
    joined = hints.join(left, "left_table").join(right, "right_table")
    return joined.withColumn("shared_columns", F.array_join("shared_columns", ", "))


_WHOLE = r"^\s*[+-]?\d+\s*$"
_REAL = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def _inferred_sql(table: str, column: str, name: str | None = None) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"""
        SELECT '{name or column}' AS column_name, CASE
          WHEN regexp_matches(lower('{name or column}'), 'date|time') THEN 'datetime'
          WHEN COUNT(*) = 0 THEN 'unknown'
          WHEN BOOL_AND(x = '' OR LOWER(x) IN ('true', 'false', '0', '1', 'yes', 'no'))
            THEN 'boolean'
          WHEN BOOL_AND(x = '' OR regexp_matches(x, '{_WHOLE}')) THEN 'integer'
          WHEN BOOL_AND(x = '' OR regexp_matches(x, '{_REAL}')) THEN 'float'
          WHEN COUNT(DISTINCT NULLIF(x, '')) BETWEEN 1 AND GREATEST(10, COUNT(*) // 5)
            THEN 'categorical'
          ELSE 'text' END AS logical_type
        FROM (SELECT {text} AS x FROM {table} WHERE {column} IS NOT NULL)
    """


@query(" UNION ALL ".join(
    [_inferred_sql("pages", c) for c in ("page_id", "url", "html")]
    + [_inferred_sql("documents", c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    + [_inferred_sql("events", c) for c in _EVENTS]
    + [_inferred_sql("labels", c) for c in ("doc_id", "quality", "toxic")]
    + [_inferred_sql("orders", c) for c in _ORDERS]
))
def profile_infer_types(t: Tables) -> DataFrame:
    tables = [t.pages, t.documents, t.events, t.labels, t.orders]
    return reduce(DataFrame.unionByName, [profiling.infer_text_types(df) for df in tables])


_DRAWN = """
    (SELECT * FROM orders ORDER BY md5('42' || chr(31) || o_orderkey::VARCHAR) LIMIT 1000)
"""


@query(f"""
    SELECT * REPLACE (FALSE AS is_candidate_key) FROM ({_profile_sql(_DRAWN, _ORDERS)})
""")
def profile_sampled(t: Tables) -> DataFrame:
    """The report on a sample of a size that is asked for; its rows follow from their keys."""
    report = profile_report(t.orders, sample_rows=1000, sample_keys=["o_orderkey"])
    columns = report.columns.drop("position", "logical_type", "sample_values")
    return columns.withColumn("null_ratio", F.round("null_ratio", 6))


@query("SELECT * FROM lineitem ORDER BY md5('7' || chr(31) || l_orderkey || chr(31) || l_linenumber) LIMIT 500")
def sample_exact(t: Tables) -> DataFrame:
    return exact_sample(t.lineitem, 500, ["l_orderkey", "l_linenumber"], seed=7)


@query(f"""
    SELECT column_name, table_rows, FALSE AS sampled, table_rows AS profiled_rows
    FROM (SELECT COUNT(*) AS table_rows FROM lineitem),
         (SELECT UNNEST({list(_LINEITEM)}) AS column_name)
""")
def profile_sample_size(t: Tables) -> DataFrame:
    """How many rows the default report looks at: all of them."""
    report = profile_report(t.lineitem)
    return report.columns.select(
        "column_name",
        report.summary.select("row_count").scalar().alias("table_rows"),
        report.summary.select("sampled").scalar().alias("sampled"),
        F.col("row_count").alias("profiled_rows"),
    )


@query(f"""
    SELECT p.*,
           CASE column_name WHEN 'c_name' THEN 'text' WHEN 'c_mktsegment' THEN 'text'
             WHEN 'c_acctbal' THEN 'float' ELSE 'integer' END AS logical_type,
           CASE column_name {" ".join(
               f"WHEN '{c}' THEN (SELECT STRING_AGG(CAST({c} AS VARCHAR), ' | ' ORDER BY c_custkey)"
               f" FROM (SELECT * FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5))"
               for c in _CUSTOMER)} END AS sample_values,
           (SELECT COUNT(*) FROM customer)
             - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_row_count,
           FALSE AS sampled
    FROM ({_profile_sql("customer", _CUSTOMER)}) p
""", name="profile_report")
def _profile_report(t: Tables) -> DataFrame:
    """The whole report, its table summary beside every column."""
    report = profile_report(t.customer, order_by="c_custkey")
    return report.columns.drop("position").select(
        "*",
        report.summary.select("duplicate_row_count").scalar().alias("duplicate_row_count"),
        report.summary.select("sampled").scalar().alias("sampled"),
    ).withColumns(
        {
            "sample_values": F.array_join("sample_values", " | "),
            "null_ratio": F.round("null_ratio", 6),
        }
    )


@query(" UNION ALL ".join(
    f"""SELECT '{column}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({column}) AS null_count,
               TRUE AS distinct_near, {"TRUE" if numeric else "NULL::BOOLEAN"} AS median_near,
               {f"MIN({column})::DOUBLE" if numeric else "NULL::DOUBLE"} AS least,
               {f"MAX({column})::DOUBLE" if numeric else "NULL::DOUBLE"} AS greatest
        FROM (SELECT * FROM events UNION ALL
              SELECT * REPLACE (-event_id - 1 AS event_id) FROM events WHERE event_type = 'purchase')"""
    for column, numeric in _EVENTS.items()
))
def profile_sketch(t: Tables) -> DataFrame:
    """The profile of a merged revision from sketches, held against exact counts and ranks."""
    store = RevisionStore(t.spark, new_folder(t.spark, "store"))
    first = store.import_table(t.events, "Events", keys=["event_id"], buckets=16)
    store.sketch(first.revision_id)
    again = t.events.filter("event_type = 'purchase'").withColumn("event_id", -F.col("event_id") - 1)
    child = store.import_merge(first.dataset_id, again, ["event_id"])
    rows, found = store.read(child.revision_id), store.sketch(child.revision_id)
    exact = profiling.distinct_counts(rows).withColumnRenamed("distinct_count", "exact")
    ranks = []
    for name in [n for n, numeric in _EVENTS.items() if numeric]:
        median = found.filter(F.col("column_name") == name).select(F.col("quartiles")[1]).scalar()
        under, upto = F.count_if(F.col(name) < median), F.count_if(F.col(name) <= median)
        error, half = sketches.RANK_ERROR * F.count(name), F.count(name) / 2
        near = (under <= half + error) & (upto >= half - error)
        ranks.append(rows.agg(F.lit(name).alias("column_name"), near.alias("median_near")))
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    return (
        found.join(exact, "column_name")
        .join(reduce(DataFrame.unionByName, ranks), "column_name", "left")
        .withColumn("distinct_near", off <= sketches.DISTINCT_ERROR * F.col("exact"))
        .select("column_name", "row_count", "null_count", "distinct_near", "median_near", "least", "greatest")
    )
