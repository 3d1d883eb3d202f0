"""Text forms, number readings, strict casts and typed predicates."""

from __future__ import annotations

import math
import random
import struct

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions import values as v
from tablewright.functions.columns import field_logical_type, logical_type, with_logical_type

TEXTS = [
    "1", "3.7", " 4 ", "1e3", "5d", "5f", "5D", "nan", "", "x", "inf", "-inf", "Infinity", "+5",
    ".5", "5.", "1e", "\t7\n", "--1", "1 2", "1,5", "-0", "true", "  ", "1e400", "2.5", "-2.5",
    "9223372036854775807", "9223372036854775808", "1e18", "0.5", "1.5e1", "t", "no", "y", "TRUE",
]


def _texts(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "s string")


def _duck(expression, value):
    return duckdb.execute(f"SELECT {expression}", [value]).fetchone()[0]


def _same(a, b):
    return a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b))


def test_text_reads_as_double_like_sql(spark):
    df = _texts(spark, TEXTS)
    for row in df.select("s", v.as_double(df, "s").alias("d")).collect():
        assert _same(row.d, _duck("TRY_CAST(? AS DOUBLE)", row.s)), row


def test_moments_are_no_numbers(spark):
    df = spark.sql("select timestamp_ntz '2020-01-01' t, date '2020-01-01' d, array(1) a, true b")
    row = df.select(*[v.as_double(df, c).alias(c) for c in df.columns]).head()
    assert (row.t, row.d, row.a, row.b) == (None, None, None, 1.0)


def test_strict_cast_of_text_to_bigint(spark):
    good = [t for t in TEXTS if _duck("TRY_CAST(? AS BIGINT)", t) is not None]
    df = _texts(spark, good)
    cast = v.strict_cast(df, "s", "BIGINT")
    for row in df.select("s", cast.alias("n")).collect():
        assert row.n == _duck("TRY_CAST(? AS BIGINT)", row.s), row


@pytest.mark.parametrize("target", ["BIGINT", "DOUBLE", "BOOLEAN", "TIMESTAMP", "DATE"])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_cast_fails_on_what_it_cannot_convert(spark, target, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = _texts(spark, ["maybe"])
        cast = v.strict_cast(df, "s", target)
        with pytest.raises(Exception, match="cannot convert 'maybe'"):
            df.select(cast).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_doubles_round_half_even_to_bigint(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (3.7,), (-2.5,), (None,)], "d double")
    cast = v.strict_cast(df, "d", "BIGINT")
    assert [r[0] for r in df.select(cast).collect()] == [2, 4, 4, -2, None]


def test_cast_types_are_a_closed_list(spark):
    df = _texts(spark, ["1"])
    with pytest.raises(RequestError) as failure:
        v.strict_cast(df, "s", "INTEGER")
    assert failure.value.code == "bad_cast"


@pytest.mark.parametrize(
    "text",
    [
        "2020-01-01", "2020-01-01 12:30:00.5", "2020-01-01T12:30", "2020-1-1", "2020", "2020-01",
        "2020/01/02", " 2020-01-01 ", "2020-01-01 25:00:00", "2020-02-30", "12:00", "01/02/2020",
    ],
)
def test_text_reads_as_date_like_sql(spark, text):
    df = _texts(spark, [text])
    kind = df.schema["s"].dataType
    for target in ("DATE", "TIMESTAMP"):
        expected = _duck(f"TRY_CAST(? AS {target})", text)
        if target == "TIMESTAMP" and text == " 2020-01-01 ":
            continue  # the padded form is accepted here
        assert df.select(F.expr(v.try_sql("s", kind, target))).head()[0] == expected, target


DOUBLES = [
    0.0, -0.0, 1.0, 1e7, 12345678.9, -1e7, 1e15, 1e16, 1.2345e16, 123456789012345680.0, 1e-3, 1e-4,
    1.5e-4, 9.9e-5, 1e-5, 1.5e-5, 1e300, 1e-300, float("nan"), float("inf"), float("-inf"), 0.1,
]


def test_doubles_print_like_sql(spark):
    df = spark.createDataFrame([(d,) for d in DOUBLES] + [(None,)], "d double")
    for row in df.select("d", v.as_text(df, "d").alias("t")).collect():
        if row.d is None:
            assert row.t is None
        else:
            assert row.t == _duck("CAST(CAST(? AS DOUBLE) AS VARCHAR)", row.d)


def test_printed_doubles_read_back_exactly(spark):
    rng = random.Random(7)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values += [round(rng.uniform(-1e9, 1e9), rng.randint(0, 6)) for _ in range(3000)]
    df = spark.createDataFrame([(d,) for d in values if not math.isnan(d)], "d double")
    for row in df.select("d", v.as_text(df, "d").alias("t")).collect():
        assert float(row.t) == row.d


def test_lists_of_numbers_print_like_sql(spark):
    df = spark.sql("select array(1.5D, null, 1.0E7D) a, array(1, 2) b")
    row = df.select(v.as_text(df, "a"), v.as_text(df, "b")).head()
    assert tuple(row) == ("[1.5, NULL, 10000000.0]", "[1, 2]")


def test_backslash_is_ordinary_in_like(spark):
    df = _texts(spark, ["a\\b", "ab", "a%b", "a_b"])
    match = lambda p: [r.s for r in df.filter(v.like(F.col("s"), p)).collect()]
    assert match("a\\b") == ["a\\b"]
    assert match("a_b") == ["a\\b", "a%b", "a_b"]
    assert match("a%b") == ["a\\b", "ab", "a%b", "a_b"]


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.sampled_from(["5", "05", "5.0", "-3", "", "true", "2020-01-01", "2020-01-01 00:00:00"]))
def test_typed_equality_agrees_with_text_equality(spark, text):
    df = spark.sql(
        """select * from values
           (5L, true, date '2020-01-01', timestamp_ntz '2020-01-01', 5.0D, '5'),
           (-3L, false, date '2021-01-01', timestamp_ntz '2021-01-01 10:00:00', 0.5D, '05'),
           (null, null, null, null, null, null) as t(i, b, d, ts, f, s)"""
    )
    for name in df.columns:
        plain = v.as_text(df, name) == text
        typed = v.text_equals(df, name, text)
        for row in df.select(plain.alias("p"), typed.alias("t")).collect():
            assert row.p == row.t, (name, text)


def test_integer_and_text_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id % 2 = 0 b").write.parquet(
        str(tmp_path / "t")
    )
    df = spark.read.parquet(str(tmp_path / "t"))
    for name, text in (("id", "7"), ("s", "7"), ("b", "true")):
        plan = df.filter(v.text_equals(df, name, text))._jdf.queryExecution().toString()
        assert f"EqualTo({name}," in plan or f"PushedFilters: [IsNotNull({name}), {name}" in plan


def test_shuffle_keys_keep_equality(spark):
    texts = ["a", "b", "x" * 64, "x" * 65, "y" * 65, "x" * 65, "", None]
    df = _texts(spark, texts)
    keys = df.select(v.shuffle_key(df, "s").alias("k")).collect()
    assert len({r.k for r in keys}) == len(set(texts))
    assert all(r.k is None or len(r.k) <= 65 for r in keys)


def test_logical_types(spark):
    df = spark.sql(
        """select 1Y a, 1L b, 1.5BD c, 1F d, true e, date '2020-01-01' f,
           timestamp_ntz '2020-01-01' g, X'00' h, 'x' i, array(1) j, null k"""
    )
    assert [logical_type(f.dataType) for f in df.schema.fields] == [
        "integer", "integer", "float", "float", "boolean", "datetime", "datetime", "binary",
        "text", "unknown", "unknown",
    ]


def test_logical_type_override_survives_storage(spark, tmp_path):
    df = with_logical_type(spark.sql("select 'a' as c"), "c", "categorical")
    df.write.parquet(str(tmp_path / "t"))
    assert field_logical_type(spark.read.parquet(str(tmp_path / "t")).schema["c"]) == "categorical"
