"""Joins by time and interval, frames, groupings and set operations against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.operators import frames, grouping, joins, sets
from tablewright.operators.charts import ChartSpec, Encoding
from tablewright.plans.dashboard import BoundChart, Dashboard, dashboard_values


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _plain_asof(left, right, exact=True, within=None):
    out = []
    for k, t, x in left:
        fits = [
            (rt, y) for rk, rt, y in right
            if None not in (k, t, rk, rt) and rk == k and (rt <= t if exact else rt < t)
        ]
        best = max(fits, key=lambda r: (r[0], r[1] is not None, r[1] or 0), default=(None, None))
        if within is not None and best[0] is not None and best[0] + within < t:
            best = (None, None)
        out.append((k, t, x, *best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("within", [None, 3])
def test_asof_join_agrees_with_the_plain_rule(spark, exact, within):
    rng = random.Random(7)
    some = lambda n, hot: [
        ("hot" if rng.random() < hot else rng.choice(["a", "b", "c", None]), rng.choice([None, *range(60)]), rng.randint(0, 9))
        for _ in range(n)
    ]
    left, right = some(300, 0.4), some(120, 0.4)
    a = spark.createDataFrame(left, "k string, t int, x int")
    b = spark.createDataFrame(right, "k string, t long, x int")
    tolerance = None if within is None else F.lit(within)
    found = joins.join_asof(a, b, ("t", "t"), [("k", "k")], exact=exact, tolerance=tolerance)
    assert found.columns == ["k", "t", "x", "t_right", "x_right"]
    wanted = _plain_asof(left, right, exact, within)
    assert _sorted(found.collect()) == wanted
    inner = joins.join_asof(a, b, ("t", "t"), [("k", "k")], how="inner", exact=exact, tolerance=tolerance)
    assert _sorted(inner.collect()) == [r for r in wanted if r[3] is not None]


def test_a_hot_key_of_an_asof_join_is_many_groups(spark):
    left = spark.range(4_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = left.filter("t % 10 = 0").withColumn("v", F.col("t"))
    found = joins.join_asof(left, right, ("t", "t"), [("k", "k")])
    assert found.filter("v <> t - t % 10").count() == 0 and found.count() == 4_000
    bounds = joins.even_bounds(left.select("t"), "t", 16)
    slices = left.groupBy(joins.slice_number(F.col("t"), bounds)).count().collect()
    assert len(slices) == 16 and max(r["count"] for r in slices) < 400
    assert joins.join_asof(left.limit(0), right, ("t", "t")).count() == 0
    assert joins.join_asof(left, right.limit(0), ("t", "t")).filter("v is null").count() == 4_000
    with pytest.raises(RequestError):
        joins.join_asof(left, right, ("t", "t"), how="outer")


@pytest.mark.parametrize("closed", [True, False])
def test_interval_join_agrees_with_the_plain_rule(spark, closed):
    rng = random.Random(8)

    def some(n):
        out = []
        for i in range(n):
            start = rng.choice([None, *range(0, 500)])
            length = rng.choice([0, 1, 3, 40, 400, -2])
            out.append((i, rng.choice(["a", "b", None]), start, None if start is None else start + length))
        return out

    def overlap(a, b):
        if None in (a[2], a[3], b[2], b[3]) or a[2] > a[3] or b[2] > b[3]:
            return False
        start = max(a[2], b[2])
        holds = lambda x: start <= x[3] if closed else start < x[3] or start == x[2] == x[3]
        return holds(a) and holds(b)

    left, right = some(120), some(90)
    a, b = (spark.createDataFrame(x, "id int, k string, f long, t long") for x in (left, right))
    span = ("f", "t")
    found = joins.join_interval(a, b, span, span, closed=closed)
    assert found.columns == ["id", "k", "f", "t", "id_right", "k_right", "f_right", "t_right"]
    wanted = sorted((x[0], y[0]) for x in left for y in right if overlap(x, y))
    assert sorted((r.id, r.id_right) for r in found.collect()) == wanted
    assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)
    keyed = joins.join_interval(a, b, span, span, [("k", "k")], closed=closed, width=0.5).collect()
    wanted = sorted((x[0], y[0]) for x in left for y in right if overlap(x, y) and x[1] == y[1] and x[1] is not None)
    assert sorted((r.id, r.id_right) for r in keyed) == wanted
    assert joins.join_interval(a.limit(0), b, span, span).count() == 0


def test_points_in_intervals_of_time(spark):
    points = spark.sql("SELECT id, TIMESTAMP_NTZ'2024-03-31 00:00:00' + make_dt_interval(0, id) AS at FROM range(48)")
    days = spark.sql("SELECT DATE'2024-03-31' AS day, DATE'2024-04-01' AS next")
    found = joins.join_interval(points, days, ("at", "at"), ("day", "next"), closed=False)
    assert sorted(r.id for r in found.collect()) == list(range(24))
    with pytest.raises(RequestError):
        joins.join_interval(points.withColumn("at", F.col("at").cast("string")), days, ("at", "at"), ("day", "next"))


def _groups(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(row[2], []).append(row)
    return out


_PLAIN = {
    "sum": sum, "count": len, "min": min, "max": max, "avg": lambda v: sum(v) / len(v),
}


def _of(values, aggregate):
    values = [v for v in values if v is not None]
    return _PLAIN[aggregate](values) if values or aggregate == "count" else None


@pytest.fixture(scope="module")
def framed():
    rng = random.Random(9)
    return [(i, rng.randint(0, 30), rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(9)])) for i in range(150)]


@pytest.mark.parametrize("aggregate", frames.AGGREGATES)
def test_frames_agree_with_plain_ones(spark, framed, aggregate):
    df = spark.createDataFrame(framed, "id int, t int, k string, v int")
    order = [F.col("t"), F.col("id")]
    wanted = {n: {} for n in ("so_far", "around", "recent")}
    for own in _groups(framed).values():
        for at, (i, t, _, _) in enumerate(own):
            wanted["so_far"][i] = _of([r[3] for r in own[: at + 1]], aggregate)
            wanted["around"][i] = _of([r[3] for r in own[max(at - 3, 0) : at + 3]], aggregate)
            wanted["recent"][i] = _of([r[3] for r in own if t - 4 <= r[1] <= t], aggregate)
    found = {
        "so_far": frames.running(df, "v", "so_far", order, ["k"], aggregate, slice_rows=7),
        "around": frames.moving_rows(df, "v", "around", order, ["k"], aggregate, preceding=3, following=2, slice_rows=7),
        "recent": frames.moving_range(df, "v", "recent", "t", ["k"], aggregate, preceding=4),
    }
    for name, rows in found.items():
        assert rows.columns == ["id", "t", "k", "v", name]
        assert {r.id: r[name] for r in rows.collect()} == pytest.approx(wanted[name])


def test_moving_ranges_do_not_add_up_whole_frames_for_every_row(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("t"), F.lit(1).alias("v"))
    found = frames.moving_range(df, "v", "s", "t", preceding=3)
    plan = _plan(found).lower()
    assert "rangeframe" in plan and plan.count("rangeframe") == plan.count("rangeframe, unboundedpreceding")
    n = [len(range(t, 20_000, 7)) for t in range(7)]
    assert {(r.t, r.s) for r in found.collect()} == {(t, sum(n[max(t - 3, 0) : t + 1])) for t in range(7)}


@pytest.mark.parametrize("kind, preceding", [
    ("long", 3), ("tinyint", 7), ("double", 0), ("double", 3), ("float", 1), ("decimal(12,2)", 3), ("decimal(38,18)", 7),
])
def test_moving_ranges_of_all_kinds_of_numbers(spark, kind, preceding):
    rng = random.Random(11)
    odd = [float("nan"), float("inf"), float("-inf"), 1e17, 1e17 + 16, 1e17 + 32, -1e300, 2.0**55, 2.0**55 + 8, 2.0**52 + 1, 2.0**52 - 3]
    some = [None, *[rng.randint(-90, 90) / 10 for _ in range(300)], *[rng.randint(-9, 9) for _ in range(40)]]
    if kind in ("double", "float"):
        some += [v if kind == "double" or abs(v) < 1e30 or v != v else v / 1e280 for v in odd for _ in (1, 2)]
    rows = [(i, None if t is None else repr(float(t)), rng.choice("ab"), rng.choice([None, *range(9)])) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "id int, t string, k string, v int")
    df = df.select("id", "k", F.col("v").cast("decimal(7,2)").alias("v"), F.col("t").cast("double").cast(kind).alias("t"))
    own = Window.partitionBy("k").orderBy("t").rangeBetween(-preceding, 0)
    for aggregate in ("sum", "avg", "min"):
        found = frames.moving_range(df, "v", "s", "t", ["k"], aggregate, preceding=preceding)
        wanted = df.withColumn("s", getattr(F, aggregate)("v").over(own))
        assert found.schema["s"].dataType == wanted.schema["s"].dataType
        assert {r.id: r.s for r in found.collect()} == {r.id: r.s for r in wanted.collect()}


def test_tiles_and_bad_frames(spark, framed):
    df = spark.createDataFrame(framed, "id int, t int, k string, v int")
    order = [F.col("t"), F.col("id")]
    for tiles in (1, 4, 200):
        wanted = {}
        for own in _groups(framed).values():
            short, longer = divmod(len(own), tiles)
            ends = [(short + 1) * min(k, longer) + short * max(k - longer, 0) for k in range(tiles + 1)]
            for at, row in enumerate(own):
                wanted[row[0]] = next(k for k in range(1, tiles + 1) if ends[k] > at)
        assert {r.id: r.tile for r in frames.ntile(df, "tile", tiles, order, ["k"]).collect()} == wanted
    whole = frames.running(df, "v", "v", order, aggregate="count", slice_rows=10)
    assert sorted(r.v for r in whole.collect()) == sorted(_counts(framed)) and whole.columns == ["id", "t", "k", "v"]
    assert frames.running(df.limit(0), "v", "s", order).count() == 0
    for bad in (
        lambda: frames.ntile(df, "tile", 0, order),
        lambda: frames.running(df, "v", "s", order, aggregate="median"),
        lambda: frames.moving_rows(df, "v", "s", order, preceding=-1),
        lambda: frames.moving_range(df, "v", "s", "t", preceding=4, slice_width=2),
    ):
        with pytest.raises(RequestError):
            bad()


def _counts(rows):
    total = 0
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        total += row[3] is not None
        yield total


def test_no_task_holds_a_whole_group_of_a_running_sum(spark):
    df = spark.range(5_000).select("id", F.lit("one").alias("k"), F.lit(1).alias("v"))
    found = frames.running(df, "v", "s", [F.col("id")], ["k"], slice_rows=500)
    assert found.filter("s <> id + 1").count() == 0
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 2 and max(tasks) < 3_000


def test_groupings_and_conditions(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, v int")
    total = {"n": ("count", None), "total": ("sum", "v")}
    cube = grouping.grouped(df, ["p", "q"], total, "cube")
    assert _sorted(r for r in cube.collect() if r.grouping_id) == [
        ("a", None, 1, 2, 3.0), (None, "x", 2, 2, 6.0), (None, None, 1, 1, 4.0), (None, None, 2, 1, 1.0), (None, None, 3, 3, 7.0),
    ]
    more = [{"column": "total", "operator": ">=", "value": 3}]
    assert _sorted(grouping.grouped(df, ["p"], total, having=more).collect()) == [("a", 2, 3.0), (None, 1, 4.0)]
    rolled = grouping.grouped(df, ["p", "q"], total, "rollup").collect()
    assert len(rolled) == 6 and sum(r.grouping_id == 3 for r in rolled) == 1
    assert len(grouping.grouped(df, ["p", "q"], total, "sets", sets=[["q"], []]).collect()) == 3
    for bad in ({"kind": "tree"}, {"kind": "sets", "sets": [["v"]]}):
        with pytest.raises(RequestError):
            grouping.grouped(df, ["p", "q"], total, **bad)
    with pytest.raises(RequestError):
        grouping.grouped(df, ["p"], {})


def test_a_dashboard_reads_its_table_once(spark, tmp_path):
    rows = [("a", "x", 1.0), ("a", None, None), (None, "x", 5.0), ("b", "y", -2.0)]
    spark.createDataFrame(rows, "p string, q string, v double").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    bar = lambda *f, **o: ChartSpec("bar", tuple(Encoding(*e) for e in f), o)
    specs = {
        "rows": bar(("x", "p")), "sum": bar(("x", "p"), ("y", "v")), "least": bar(("x", "q"), ("y", "v", "min")),
        "count": bar(("x", "q"), ("y", "p", "count")), "mean": bar(("x", "p"), ("y", "v", "mean")),
        "few": bar(("x", "p"), ("y", "v", "max"), filters=[{"field": "q", "op": "eq", "value": "x"}]),
    }
    charts = {n: BoundChart(s, table) for n, s in specs.items()}
    together = dashboard_values(Dashboard("d", tuple(charts)), charts)
    assert _plan(together).count("FileScan parquet") == 1
    alone = [
        (r.widget, r.category, r.value)
        for n, b in charts.items()
        for r in dashboard_values(Dashboard("d", (n,)), {n: b}).collect()
    ]
    assert _sorted(together.collect()) == sorted(alone, key=repr)
    assert ("few", "a", 1.0) in alone and ("count", None, 1.0) in alone and ("rows", None, 1.0) in alone
    assert ("few", "b", -2.0) not in alone and ("sum", "b", -2.0) in alone


def test_set_operations_count_repeats(spark, monkeypatch):
    monkeypatch.setattr(sets, "COPIES", 3)
    rng = random.Random(10)
    some = lambda n: [rng.choice([("a", 1.0, None), ("a", -0.0, b"x"), (None, float("nan"), b""), ("t" * 9_000, 2.0, b"y")]) for _ in range(n)]
    left, right = some(60), some(25)
    a, b = (spark.createDataFrame(x, "s string, d double, b binary") for x in (left, right))
    b = b.withColumnRenamed("s", "other")
    key = lambda r: repr(tuple(bytes(x) if isinstance(x, bytearray) else 0.0 if x == 0 else x for x in r))
    n, m = (Counter(map(key, x)) for x in (left, right))
    assert Counter(map(key, sets.intersect_all(a, b).collect())) == n & m
    assert Counter(map(key, sets.except_all(a, b).collect())) == n - m
    diff = Counter()
    for r in sets.revision_diff(a, b).collect():
        diff[r.change, key(r[2:])] = r.copies
    assert diff == Counter({("removed", k): v for k, v in (n - m).items()} | {("added", k): v for k, v in (m - n).items()})
    assert sets.revision_diff(a, a).count() == 0
    with pytest.raises(RequestError):
        sets.except_all(a, b.select("other"))
