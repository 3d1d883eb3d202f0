"""Stored revisions, pages and lineage."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.operators import lineage, paging
from tablewright.plans.pipeline import CleaningPipeline
from tablewright.store.revisions import RevisionStore


@pytest.fixture
def store(spark, tmp_path):
    return RevisionStore(spark, str(tmp_path / "store"))


def _numbers(spark, count, parts):
    df = spark.range(0, count, numPartitions=parts)
    return df.select("id", F.concat(F.lit("row"), "id").alias("name"))


def test_pages_follow_arrival(spark, store):
    revision = store.import_table(_numbers(spark, 1000, 4), "Numbers").revision_id
    page = store.page(revision, offset=100, limit=50)
    assert page.columns == ["id", "name"]
    assert [r.id for r in page.collect()] == list(range(100, 150))
    assert store.row_count(revision) == 1000


@pytest.mark.parametrize(
    ("offset", "limit", "expected"),
    [(0, 3, [0, 1, 2]), (249, 3, [249, 250, 251]), (998, 10, [998, 999]), (1000, 5, []),
     (5, 0, []), (100, 700, list(range(100, 800)))],
)
def test_page_edges(spark, store, offset, limit, expected):
    revision = store.import_table(_numbers(spark, 1000, 4)).revision_id
    assert [r.id for r in store.page(revision, offset, limit).collect()] == expected


def test_big_grid(spark, store):
    revision = store.import_table(_numbers(spark, 100_000, 5)).revision_id
    assert store.page(revision, 50_000, 1).head().id == 50_000
    assert store.page(revision, 99_999, 500).head().id == 99_999


def test_page_range_reaches_the_scan(spark, store):
    revision = store.import_table(_numbers(spark, 1000, 4)).revision_id
    plan = store.page(revision, 500, 10)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "name#" in line]
    assert len(scans) == 1
    assert "_ordinal" in scans[0].split("DataFilters: ")[1].split("Format:")[0]
    assert "Join" not in plan


def test_sorted_pages(spark, store):
    rows = [(3, "a"), (None, "b"), (1, "c"), (3, "d"), (2, "e")]
    df = spark.createDataFrame(rows, "n int, s string").coalesce(1)
    revision = store.import_table(df).revision_id
    up = store.page(revision, 0, 10, order_by="n").collect()
    assert [r.s for r in up] == ["c", "e", "a", "d", "b"]
    down = store.page(revision, 1, 2, order_by="n", descending=True).collect()
    assert [r.s for r in down] == ["d", "e"]
    with pytest.raises(RequestError):
        store.page(revision, 0, 1, order_by="x")


@pytest.mark.parametrize("descending", [False, True])
def test_deep_sorted_pages_equal_shallow_ones(spark, descending):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(6)
    ask = {"descending": descending, "ties": ["i"]}
    for offset in (0, 700, 2990, 5000):
        shallow = paging.sorted_page(df, "k", offset, 25, **ask).collect()
        for top_rows in (10, 200):
            assert paging.sorted_page(df, "k", offset, 25, top_rows=top_rows, **ask).collect() == shallow


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["string", "double", "decimal(12,2)", "timestamp", "boolean"])
def test_a_deep_page_is_narrowed_down_to(spark, monkeypatch, descending, kind):
    value = {
        "string": "if(id % 7 = 0, null, concat('a long prefix ', id * 7919 % 5000))",
        "double": "case when id % 5 = 0 then double('nan') when id % 7 = 0 then null else -id / 3.0 end",
        "boolean": "if(id % 3 = 0, null, id % 2 = 0)",
        "timestamp": "timestamp_seconds(id * 7919 % 5000)",
    }.get(kind, "id * 7919 % 5000")
    df = paging.written(paging.with_ordinal(spark.range(0, 20000, 1, 7).selectExpr(f"CAST({value} AS {kind}) k", "id")), "t")
    kept = []
    write = paging.written
    monkeypatch.setattr(paging, "written", lambda d, name: kept.append((name, write(d, name))) or kept[-1][1])
    for offset in (12_000, 19_990):
        ordered = df.orderBy(df.k.desc_nulls_last() if descending else df.k.asc_nulls_last(), paging.ORDINAL)
        expected = [r.id for r in ordered.select("id").collect()[offset : offset + 30]]
        found = paging.sorted_page(df, "k", offset, 30, descending=descending, top_rows=1_000)
        assert [r.id for r in found.collect()] == expected and found.columns == ["k", "id"]
    # All that is written is drawn keys, and those around the page.
    assert {name for name, _ in kept} == {"drawn-keys", "page-candidates"}
    assert sum(d.count() for name, d in kept if name == "page-candidates") < 8_000


def test_names_of_datasets_are_not_paths(spark, store):
    revision = store.import_table(_numbers(spark, 3, 1), "My ../ Data")
    paths = [str(p) for p in Path(store.root).rglob("*")]
    assert not any("Data" in p for p in paths) and any(revision.revision_id in p for p in paths)


def test_every_import_is_a_new_dataset(spark, store):
    one, two = (store.import_table(_numbers(spark, 3, 1), "Same") for _ in range(2))
    assert one.dataset_id != two.dataset_id and store.catalog().count() == 2


def test_cleaning_makes_a_child_revision(spark, store):
    first = store.import_table(_numbers(spark, 10, 2), "Numbers")
    steps = CleaningPipeline.of(("filter_rows", {"column": "id", "operator": ">", "value": 6}))
    child = store.apply_cleaning(first.dataset_id, steps)
    assert child.parent_id == first.revision_id and child.label == "clean"
    assert store.current(first.dataset_id).revision_id == child.revision_id
    assert [r.id for r in store.page(child.revision_id, 1, 5).collect()] == [8, 9]
    assert store.read(first.revision_id).count() == 10
    again = CleaningPipeline.from_json(store.current(first.dataset_id).pipeline)
    assert again.apply(store.read(first.revision_id)).count() == 3
    rows = store.lineage(first.dataset_id).collect()
    assert {(r.revision_id, r.root_id, r.depth) for r in rows} == {
        (first.revision_id, first.revision_id, 0), (child.revision_id, first.revision_id, 1),
    }


def test_failed_work_leaves_nothing_visible(spark, store):
    first = store.import_table(_numbers(spark, 10, 2))
    bad = CleaningPipeline.of(("cast_column", {"column": "name", "duck_type": "BIGINT"}))
    with pytest.raises(Exception, match="cannot convert"):
        store.apply_cleaning(first.dataset_id, bad)
    assert store.current(first.dataset_id) == first
    with pytest.raises(RequestError):
        store.current("nothing")


def test_empty_and_untyped_imports(spark, store):
    empty = store.import_table(spark.createDataFrame([], "a int, b string"))
    assert store.read(empty.revision_id).dtypes == [("a", "int"), ("b", "string")]
    assert store.row_count(empty.revision_id) == 0
    assert store.page(empty.revision_id).collect() == []
    untyped = store.import_table(spark.sql("select null as _empty where false"))
    assert store.read(untyped.revision_id).dtypes == [("_empty", "string")]


def test_profiles_are_kept(spark, store):
    revision = store.import_table(_numbers(spark, 50, 2)).revision_id
    columns, summary = store.profile(revision)
    assert {r.column_name: r.distinct_count for r in columns.collect()} == {"id": 50, "name": 50}
    assert summary.head().row_count == 50
    written = sorted(Path(store.root, "profiles").rglob("*.parquet"))
    assert store.profile(revision)[1].head().row_count == 50
    assert sorted(Path(store.root, "profiles").rglob("*.parquet")) == written
    samples = {r.column_name: r.sample_values for r in columns.collect()}
    assert samples["id"] == ["0", "1", "2", "3", "4"]


def test_lineage_agrees_with_brute_force(spark):
    rng = random.Random(2)
    parents = {f"r{i}": f"r{rng.randrange(max(0, i - 4), i)}" if i % 50 else None for i in range(300)}
    parents["orphan"] = "gone"

    def climb(revision):
        depth = 0
        while parents.get(revision) in parents:
            revision, depth = parents[revision], depth + 1
        return revision, depth

    df = spark.createDataFrame(list(parents.items()), "revision_id string, parent_id string")
    rows = lineage.revision_lineage(df).collect()
    assert {r.revision_id: (r.root_id, r.depth) for r in rows} == {r: climb(r) for r in parents}


def test_lineage_with_a_cycle_is_an_error(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "revision_id string, parent_id string")
    with pytest.raises(RuntimeError, match="cycle"):
        lineage.revision_lineage(df, max_rounds=4)


def test_a_column_called_like_the_ordinal_is_kept(spark, store):
    df = spark.createDataFrame([(7, "a")], "_ordinal int, v string")
    revision = store.import_table(df).revision_id
    assert [tuple(r) for r in store.read(revision).collect()] == [(7, "a")]


def test_profiles_of_different_samples_are_kept_apart(spark, store):
    revision = store.import_table(spark.range(300).toDF("n")).revision_id
    assert store.profile(revision, sample_rows=40)[0].head().row_count == 40
    assert store.profile(revision)[0].head().row_count == 300


def test_finished_revisions_leave_the_rounds(spark):
    rows = [("root", None), *[(f"c{i}", "root") for i in range(50)], ("g", "c1"), ("h", "g"), ("lost", "gone")]
    df = spark.createDataFrame(rows, "revision_id string, parent_id string")
    found = {r.revision_id: (r.root_id, r.depth) for r in lineage.revision_lineage(df).collect()}
    assert found["h"] == ("root", 3) and found["c7"] == ("root", 1) and found["lost"] == ("lost", 0)
    assert len(found) == 54
