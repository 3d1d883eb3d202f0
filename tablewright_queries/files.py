"""Queries that write tables as files and read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.cleaning import cast_column
from tablewright.sinks import tabular
from tablewright.sources import delimited, documents
from tablewright.sources.partitioned import read_partitioned, write_partitioned
from tablewright.workspace import new_folder
from tablewright_queries.registry import Tables, query


@query("SELECT * FROM lineitem")
def src_csv(t: Tables) -> DataFrame:
    """Semicolon-separated text; delimiter and types are found from the files."""
    path = new_folder(t.spark, "csv")
    t.lineitem.write.option("header", True).option("sep", ";").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)
    read = delimited.read_delimited(t.spark, path)
    # Whole numbers are read with 64 bits.
    return read.withColumn("l_linenumber", F.col("l_linenumber").cast("int"))


_FORMS = {"comma": ",", "semicolon": ";", "tab": "\t"}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS written_as, '{sign}' AS delimiter, COUNT(*) > 0 AS found FROM part"
    for name, sign in _FORMS.items()
))
def src_delimiter(t: Tables) -> DataFrame:
    """The same table in three forms, each a directory of files."""
    parts = []
    for name, sign in _FORMS.items():
        path = new_folder(t.spark, name)
        t.part.write.option("header", True).option("sep", sign).csv(path)
        detected = delimited.detect_delimiters(t.spark, path)
        parts.append(
            detected.groupBy(F.lit(name).alias("written_as"), "delimiter").agg(
                (F.count(F.lit(1)) > 0).alias("found")
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query("SELECT * FROM customer")
def src_json(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "json")
    t.customer.write.json(path)
    read = documents.read_json(t.spark, path, lines=True)
    return read.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("""
    SELECT event_id, value AS "measure.value", user_id AS "source.user.id",
           event_type AS "source.user.action", CAST(ts AS VARCHAR) AS "source.at",
           CAST(props->>'$.k' AS BIGINT) AS "props.k"
    FROM events
""")
def src_json_flatten(t: Tables) -> DataFrame:
    """Events written as nested objects, their own JSON text parsed into the nest."""
    nested = t.events.select(
        "event_id",
        F.struct("value").alias("measure"),
        F.struct(
            F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("action")).alias("user"),
            F.col("ts").cast("string").alias("at"),
        ).alias("source"),
        F.from_json("props", "k bigint").alias("props"),
    )
    path = new_folder(t.spark, "json")
    nested.write.json(path)
    return documents.read_json(t.spark, path, lines=True)


#: Records in one JSON value: a file of this kind is one task, whatever the size of the table.
_RECORDS = 500


def _as_arrays(df: DataFrame, path: str, before: str, after: str, between: str = ",") -> None:
    """Write a table as files that hold one JSON value each, ``_RECORDS`` records within a text."""
    turn = F.floor(F.monotonically_increasing_id() / _RECORDS)
    lines = df.select(turn.alias("file"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    whole = lines.groupBy("file").agg(F.array_join(F.collect_list("record"), between).alias("records"))
    text = F.concat(F.lit(before), "records", F.lit(after)).alias("value")
    whole.select("file", text).write.partitionBy("file").text(path)


@query("""
    SELECT * EXCLUDE (c_acctbal, c_nationkey), c_nationkey::BIGINT AS c_nationkey, c_acctbal AS "items.balance" FROM customer
""")
def src_json_array(t: Tables) -> DataFrame:
    """Root arrays, whose records have a field with the name of a wrapper."""
    path = new_folder(t.spark, "json")
    balance = F.struct(F.col("c_acctbal").alias("balance")).alias("items")
    _as_arrays(t.customer.select("*", balance).drop("c_acctbal"), path, "[", "]")
    return documents.read_json(t.spark, f"{path}/*")


_SUPPLIER = "SELECT * REPLACE (s_nationkey::BIGINT AS s_nationkey) FROM supplier"


@query(f"{_SUPPLIER} UNION ALL {_SUPPLIER}")
def src_json_wrapped(t: Tables) -> DataFrame:
    """The same records below a field of a root object and in a root array, side by side."""
    path = new_folder(t.spark, "json")
    _as_arrays(t.supplier, f"{path}/form=wrapped", '{"n": 1, "records": [', "]}")
    _as_arrays(t.supplier, f"{path}/form=plain", "[", "]")
    return documents.read_json(t.spark, path + "/*/*")


@query("""
    SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part UNION ALL BY NAME SELECT 7::BIGINT AS value FROM part
""")
def src_json_mixed(t: Tables) -> DataFrame:
    """Arrays of records with a plain value after each."""
    path = new_folder(t.spark, "json")
    _as_arrays(t.part, path, "[", ",7]", between=",7,")
    return documents.read_json(t.spark, f"{path}/*")


@query("SELECT * FROM supplier UNION ALL SELECT * FROM supplier")
def src_csv_reordered(t: Tables) -> DataFrame:
    """Files that differ in their delimiter and in the order of their columns."""
    path = new_folder(t.spark, "csv")
    names = t.supplier.columns
    for order, sign in ((names, ","), (names[::-1], ";")):
        part = t.supplier.select(*order).write.option("header", True).option("sep", sign)
        part.csv(f"{path}/form={len(sign)}{ord(sign)}")
    read = delimited.read_delimited(t.spark, path + "/*").select(*names)
    return read.withColumn("s_nationkey", F.col("s_nationkey").cast("int"))


@query("""
    SELECT o_orderkey AS a, o_orderstatus AS a_1, o_custkey AS a_1_1, o_orderpriority AS col_3, o_totalprice AS b,
           o_orderdate AS b_1
    FROM orders
""")
def src_headers(t: Tables) -> DataFrame:
    """Repeated and missing header cells, which every one of the files begins with."""
    path = new_folder(t.spark, "csv")
    moment = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    cells = F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority", "o_totalprice", moment)
    place = F.monotonically_increasing_id()
    rows = t.orders.repartition(4).select(cells.alias("row"), (place % 2**33 == 0).alias("starts"))
    header = F.when(F.col("starts"), F.array(F.lit("a,a,a_1,,b,b"), "row")).otherwise(F.array("row"))
    rows.select(F.explode(header)).write.text(path)
    return delimited.read_delimited(t.spark, path)


@query("SELECT * FROM orders LIMIT 200")
def src_preview(t: Tables) -> DataFrame:
    return delimited.preview(t.orders)


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def export_capped(t: Tables) -> DataFrame:
    """The cap is the feature: the first rows of the table, by as many tasks as hold them."""
    return tabular.capped(t.orders, cap=1000)


@query("""
    SELECT LEAST(COUNT(*), 5000) AS row_count, COUNT(*) >= 5000 AS truncated FROM orders
""")
def export_summary(t: Tables) -> DataFrame:
    return tabular.export_summary(t.orders, cap=5000)


@query("SELECT * FROM orders")
def export_csv(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "export")
    tabular.write_csv(t.orders, path)
    return delimited.read_delimited(t.spark, path)


@query(f"""
    SELECT doc_id, {", ".join(f"CASE WHEN {n} NOT IN {delimited.NULL_TOKENS} THEN {n} END AS {n}" for n in ("text", "lang", "source"))},
           n_chars
    FROM documents
""")
def export_csv_lines(t: Tables) -> DataFrame:
    """Texts with line breaks, quotes and white space at their ends, written and read back."""
    path = new_folder(t.spark, "export")
    tabular.write_csv(t.documents, path)
    return delimited.read_delimited(t.spark, path, delimiter=",", schema=t.documents.schema, multiline=True)


@query("SELECT * FROM orders")
def export_json(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "export")
    tabular.write_json(t.orders, path)
    return cast_column(documents.read_json(t.spark, path, lines=True), "o_orderdate", "TIMESTAMP")


@query("""
    SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus,
           CASE WHEN l_linestatus = 'O' THEN l_tax END AS l_tax, year(l_shipdate)::INTEGER AS ship_year
    FROM lineitem
    WHERE year(l_shipdate) IN (SELECT year(o_orderdate) FROM orders WHERE o_orderstatus = 'P')
""")
def src_partitioned(t: Tables) -> DataFrame:
    """Line items by year of shipment; the earlier files lack a column.

    The years come from a join, so the folders of other years are pruned at run time.
    """
    folder = new_folder(t.spark, "partitioned")
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", "l_tax", F.year("l_shipdate").alias("ship_year")
    )
    open_lines = F.col("l_linestatus") == "O"
    write_partitioned(lines.filter(~open_lines).drop("l_tax"), folder, ["ship_year"])
    write_partitioned(lines.filter(open_lines), folder, ["ship_year"], append=True)
    stored = read_partitioned(t.spark, folder, partitions="ship_year int")
    years = t.orders.filter("o_orderstatus = 'P'").select(F.year("o_orderdate").alias("ship_year"))
    return stored.join(years.distinct(), "ship_year", "left_semi")


@query("SELECT * FROM events")
def src_orc(t: Tables) -> DataFrame:
    """Events as ORC in folders by type; numbers keep their types and NULL its place."""
    folder = new_folder(t.spark, "orc")
    write_partitioned(t.events, folder, ["event_type"], form="orc")
    return read_partitioned(t.spark, folder, form="orc", partitions="event_type string").select(t.events.columns)
