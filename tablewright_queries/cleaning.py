"""Cleaning queries: one step each, then pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import cleaning as s
from tablewright.plans.pipeline import CleaningPipeline
from tablewright.store.revisions import RevisionStore
from tablewright.workspace import new_folder
from tablewright_queries.registry import Tables, query


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def clean_drop_columns(t: Tables) -> DataFrame:
    return s.drop_columns(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("""
    SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, c_name AS customer_name FROM customer
""")
def clean_rename(t: Tables) -> DataFrame:
    return s.rename_column(t.customer, "c_name", "customer_name")


@query("""
    SELECT o_orderstatus, o_orderpriority, CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(o_totalprice AS BIGINT) AS o_totalprice,
           CAST(o_orderdate AS DATE) AS o_orderdate
    FROM orders
""")
def clean_cast(t: Tables) -> DataFrame:
    return CleaningPipeline.of(
        ("cast_column", {"column": "o_orderkey", "duck_type": "VARCHAR"}),
        ("cast_column", {"column": "o_custkey", "duck_type": "DOUBLE"}),
        ("cast_column", {"column": "o_totalprice", "duck_type": "BIGINT"}),
        ("cast_column", {"column": "o_orderdate", "duck_type": "DATE"}),
    ).apply(t.orders)


_PRINTED = """
    (SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS VARCHAR) AS half,
            CAST(l_shipdate AS VARCHAR) AS shipped, CAST(l_orderkey % 2 AS VARCHAR) AS odd
     FROM lineitem)
"""


@query(f"""
    SELECT l_orderkey, l_linenumber, CAST(half AS BIGINT) AS half,
           CAST(shipped AS TIMESTAMP) AS shipped, CAST(odd AS BOOLEAN) AS odd
    FROM {_PRINTED}
""")
def clean_cast_text(t: Tables) -> DataFrame:
    """Numbers, moments and truth values are printed first, then read back from their text."""
    printed = CleaningPipeline.of(
        ("cast_column", {"column": "half", "duck_type": "VARCHAR"}),
        ("cast_column", {"column": "shipped", "duck_type": "VARCHAR"}),
        ("cast_column", {"column": "odd", "duck_type": "VARCHAR"}),
    ).apply(
        t.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            (F.col("l_quantity") / 2).alias("half"),
            F.col("l_shipdate").alias("shipped"),
            (F.col("l_orderkey") % 2).alias("odd"),
        )
    )
    return CleaningPipeline.of(
        ("cast_column", {"column": "half", "duck_type": "BIGINT"}),
        ("cast_column", {"column": "shipped", "duck_type": "timestamp"}),
        ("cast_column", {"column": "odd", "duck_type": "boolean"}),
    ).apply(printed)


_RATED = "(SELECT * REPLACE (NULLIF(o_orderpriority, '3-MEDIUM') AS o_orderpriority) FROM orders)"


def _rated(t: Tables) -> DataFrame:
    """Orders in which the medium priority is missing."""
    medium = F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    return t.orders.withColumn("o_orderpriority", medium)


@query(f"""
    SELECT * EXCLUDE (o_orderpriority), COALESCE(o_orderpriority, 'UNRATED') AS o_orderpriority
    FROM {_RATED}
""")
def clean_fill_null(t: Tables) -> DataFrame:
    return s.fill_null(_rated(t), "o_orderpriority", "UNRATED")


@query(f"SELECT * FROM {_RATED} WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL")
def clean_drop_nulls(t: Tables) -> DataFrame:
    return s.drop_nulls(_rated(t), ["o_orderpriority", "o_custkey"])


@query("SELECT * REPLACE (TRIM('  ' || p_name || ' ') AS p_name) FROM part")
def clean_trim(t: Tables) -> DataFrame:
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return s.trim_column(t.part.withColumn("p_name", padded), "p_name")


@query("""
    SELECT doc_id, text, source, n_chars, CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS lang
    FROM documents
""")
def clean_replace(t: Tables) -> DataFrame:
    return s.replace_values(t.documents, "lang", "en", "english")


@query("""
    SELECT event_id, ts, user_id, event_type, value, props FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n
      FROM events
    ) WHERE n = 1
""")
def clean_dedupe(t: Tables) -> DataFrame:
    return s.dedupe(t.events, ["user_id", "event_type"], order_by=["event_id"])


@query("SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')")
def clean_distinct(t: Tables) -> DataFrame:
    return s.dedupe(t.lineitem.unionByName(t.lineitem.filter("l_returnflag = 'R'")))


@query("""
    SELECT * FROM orders
    WHERE o_totalprice >= 250000 AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus != 'P'
""")
def clean_filter_cmp(t: Tables) -> DataFrame:
    return CleaningPipeline.of(
        ("filter_rows", {"column": "o_totalprice", "operator": ">=", "value": 250000}),
        ("filter_rows", {"column": "o_orderdate", "operator": "<", "value": "1997-01-01"}),
        ("filter_rows", {"column": "o_orderstatus", "operator": "!=", "value": "P"}),
    ).apply(t.orders)


@query("SELECT * FROM part WHERE p_name LIKE 's%_ring%'")
def clean_filter_like(t: Tables) -> DataFrame:
    return s.filter_rows(t.part, "p_name", "LIKE", "s%_ring%")


_TIDY = CleaningPipeline.of(
    ("trim_column", {"column": "o_orderstatus"}),
    ("fill_null", {"column": "o_orderpriority", "value": "UNRATED"}),
    ("filter_rows", {"column": "o_totalprice", "operator": ">", "value": 1000.5}),
    ("dedupe", {"columns": ["o_custkey", "o_orderpriority"], "order_by": ["o_orderkey"]}),
    ("drop_columns", {"columns": ["o_orderdate"]}),
)


def _tidy_sql(source: str) -> str:
    return f"""
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM (
          SELECT *, ROW_NUMBER() OVER (
                      PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n
          FROM (
            SELECT o_orderkey, o_custkey, o_totalprice, TRIM(o_orderstatus) AS o_orderstatus,
                   COALESCE(o_orderpriority, 'UNRATED') AS o_orderpriority
            FROM {source}
          ) WHERE o_totalprice > 1000.5
        ) WHERE n = 1
    """


@query(_tidy_sql(_RATED))
def clean_pipeline(t: Tables) -> DataFrame:
    return _TIDY.apply(_rated(t))


@query(_tidy_sql("orders"))
def clean_replay(t: Tables) -> DataFrame:
    """The same steps, stored as JSON and replayed on another table."""
    return CleaningPipeline.from_json(_TIDY.to_json()).apply(t.orders)


@query(_tidy_sql(_RATED))
def clean_apply(t: Tables) -> DataFrame:
    """The same steps run on a stored dataset, giving a child revision that is read back."""
    store = RevisionStore(t.spark, new_folder(t.spark, "store"))
    first = store.import_table(_rated(t), "Orders")
    return store.read(store.apply_cleaning(first.dataset_id, _TIDY).revision_id)


@query("""
    SELECT p_partkey, p_brand, p_type, p_size, p_retailprice, UPPER(p_name) AS p_name
    FROM part WHERE p_size > 10
""")
def clean_custom_step(t: Tables) -> DataFrame:
    """A step registered by the user, between built-in ones."""

    def upper(df: DataFrame, params: s.Params) -> DataFrame:
        name = params["column"]
        return df.select(*[n for n in df.columns if n != name], F.upper(name).alias(name))

    s.register_step("upper_case", upper)
    return CleaningPipeline.of(
        ("filter_rows", {"column": "p_size", "operator": ">", "value": 10}),
        ("upper_case", {"column": "p_name"}),
    ).apply(t.part)
