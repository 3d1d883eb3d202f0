"""Merge imports into keyed datasets, and profiles from sketches that their revisions share."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.operators import profiling, sketches
from tablewright.plans.pipeline import CleaningPipeline
from tablewright.store.revisions import RevisionStore


@pytest.fixture
def store(spark, tmp_path):
    return RevisionStore(spark, str(tmp_path / "store"))


def _items(spark, count=400):
    return spark.range(count).select("id", F.concat(F.lit("v"), "id").alias("name"))


def _changes(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, op string")


def _as_dict(df):
    return {r.id: r.name for r in df.collect()}


def _files(store, revision):
    return {str(p) for place in (store._places(revision.revision_id) or {}).values() for p in Path(place).glob("*.parquet")}


def test_merge_replaces_adds_and_deletes(spark, store):
    first = store.import_table(_items(spark), keys=["id"], buckets=32)
    changes = _changes(spark, [(3, "new", "u"), (1000, "added", "u"), (7, None, "d"), (5000, "none", "d")])
    second = store.import_merge(first.dataset_id, changes, ["id"], delete="op = 'd'")
    expected = {i: f"v{i}" for i in range(400) if i != 7} | {3: "new", 1000: "added"}
    assert _as_dict(store.read(second.revision_id)) == expected
    assert _as_dict(store.read(first.revision_id)) == {i: f"v{i}" for i in range(400)}
    assert store.row_count(second.revision_id) == 400
    assert second.parent_id == first.revision_id
    assert store.current(first.dataset_id).layout == first.layout


def test_untouched_files_are_shared(spark, store):
    first = store.import_table(_items(spark), keys=["id"], buckets=32)
    second = store.import_merge(first.dataset_id, _changes(spark, [(3, "new", "u")]), ["id"])
    shared = _files(store, first) & _files(store, second)
    assert len(store._places(first.revision_id)) == 32
    assert len(_files(store, first) - shared) == len(_files(store, second) - shared) == 1


def test_pages_of_merged_revisions_hold_every_row_once(spark, store):
    revision = store.import_table(_items(spark), keys=["id"], buckets=8)
    for n in range(3):
        rows = [(n, f"again{n}", "u"), (900 + n, "x", "u"), (50 + n, "gone", "d")]
        revision = store.import_merge(revision.dataset_id, _changes(spark, rows), ["id"], delete="op = 'd'")
    total = store.row_count(revision.revision_id)
    assert total == 400
    paged = [r.id for start in range(0, total, 70) for r in store.page(revision.revision_id, start, 70).collect()]
    assert sorted(paged) == sorted(_as_dict(store.read(revision.revision_id)))
    assert store.page(revision.revision_id, 5, 3, order_by="id").columns == ["id", "name"]


def test_a_dataset_without_keys_is_laid_out_by_its_first_merge(spark, store):
    first = store.import_table(_items(spark, 50))
    second = store.import_merge(first.dataset_id, _changes(spark, [(3, "new", "u")]), ["id"], buckets=4)
    assert _as_dict(store.read(second.revision_id))[3] == "new"
    cleaned = store.apply_cleaning(first.dataset_id, CleaningPipeline.of(("drop_nulls", {"columns": ["name"]})))
    assert cleaned.layout is None
    third = store.import_merge(first.dataset_id, _changes(spark, [(4, "four", "u")]), ["id"], buckets=4)
    assert store.row_count(third.revision_id) == 50


def test_null_keys_repeats_and_clashing_names(spark, store):
    df = spark.createDataFrame(
        [(None, "a", 1), (None, "b", 2), (2, "c", 3)], "id long, bucket_no string, key_digest int"
    )
    first = store.import_table(df, keys=["id"], buckets=4)
    change = spark.createDataFrame([(None, "z", 9, 1), (None, "y", 8, 2)], "id long, bucket_no string, key_digest int, n int")
    with pytest.raises(RequestError):
        store.import_merge(first.dataset_id, change, ["id"])
    second = store.import_merge(first.dataset_id, change, ["id"], order_by=["n"])
    rows = sorted(tuple(r) for r in store.read(second.revision_id).select(F.coalesce("id", F.lit(-1)), "bucket_no", "key_digest").collect())
    assert rows == [(-1, "y", 8), (2, "c", 3)]


def test_empty_changes_empty_tables_and_other_types(spark, store):
    first = store.import_table(_items(spark, 20), keys=["id"], buckets=4)
    same = store.import_merge(first.dataset_id, _changes(spark, []), ["id"])
    assert _files(store, same) == _files(store, first)
    gone = _items(spark, 20).withColumn("op", F.lit("d"))
    empty = store.import_merge(first.dataset_id, gone, ["id"], delete="op = 'd'")
    assert store.read(empty.revision_id).collect() == []
    assert [r.distinct_count for r in store.sketch(empty.revision_id).collect()] == [0, 0]
    again = store.import_merge(first.dataset_id, _items(spark, 3), ["id"])
    assert store.row_count(again.revision_id) == 3
    with pytest.raises(RequestError):
        store.import_merge(first.dataset_id, spark.createDataFrame([(1, 2)], "id int, name int"), ["id"])
    with pytest.raises(RequestError):
        store.import_table(_items(spark, 3), keys=["nope"])


def test_a_hot_key_is_many_files(spark, store):
    rows = spark.range(0, 60_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        first = store.import_table(rows, keys=["k"], buckets=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = [len(list(Path(p).glob("*.parquet"))) for p in store._places(first.revision_id).values()]
    assert max(sizes) > 2
    assert store.row_count(first.revision_id) == 60_000


def test_sketches_are_close_to_the_exact_profile(spark):
    df = spark.range(50_000).select(
        "id",
        (F.col("id") % 777).cast("int").alias("few"),
        F.when(F.col("id") % 4 > 0, F.sqrt("id")).alias("real"),
        F.concat(F.lit("t"), F.col("id") % 9000).alias("text"),
        F.lit(None).cast("double").alias("none"),
    )
    exact = {r.column_name: r for r in profiling.profile_columns(df).collect()}
    for row in sketches.profile_sketch(df).collect():
        assert (row.row_count, row.null_count) == (50_000, exact[row.column_name].null_count)
        count = exact[row.column_name].distinct_count
        assert abs(row.distinct_count - count) <= sketches.DISTINCT_ERROR * count
        if row.column_name == "id":
            ranks = [q / 50_000 for q in row.quartiles]
            assert all(abs(a - b) <= sketches.RANK_ERROR for a, b in zip(ranks, (0.25, 0.5, 0.75), strict=True))
            assert (row.least, row.greatest) == (0, 49_999)
        if row.column_name == "none":
            assert row.quartiles is None and row.distinct_count == 0


def test_sketches_take_nan_zeros_and_no_rows(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (-0.0,), (None,)], "x double")
    row = sketches.profile_sketch(df).head()
    assert (row.row_count, row.null_count, row.distinct_count, row.least) == (4, 1, 2, 0.0)
    only = sketches.profile_sketch(df.filter("isnan(x)")).head()
    assert (only.distinct_count, only.quartiles) == (1, None)
    none = sketches.profile_sketch(df.limit(0)).head()
    assert (none.row_count, none.distinct_count, none.least) == (0, 0, None)


def test_a_child_reads_its_own_buckets_only(spark, store):
    first = store.import_table(_items(spark), keys=["id"], buckets=32)
    store.sketch(first.revision_id).collect()
    second = store.import_merge(first.dataset_id, _changes(spark, [(3, "new", "u"), (900, "v1", "u")]), ["id"])
    # Files of shared buckets are gone, so whoever reads them fails.
    changed = set(store._places(second.revision_id).values()) - set(store._places(first.revision_id).values())
    shared = set(store._places(second.revision_id).values()) - changed
    names = store._sketched_buckets(second.revision_id, store._places(second.revision_id))
    read = {Path(f.removeprefix("file:")).parent.as_posix() for f in names.inputFiles() if "/data/" in f}
    assert read == {Path(p).as_posix() for p in changed} and shared
    found = {r.column_name: r for r in store.sketch(second.revision_id).collect()}
    assert found["id"].row_count == 401 and found["id"].greatest == 900
    assert abs(found["id"].distinct_count - 401) <= 13


def test_hints_come_from_the_catalog(spark, store):
    one = store.import_table(_items(spark, 3), "One")
    two = store.import_table(spark.range(3).select("id", F.lit(1).alias("NAME")), "Two")
    store.import_table(spark.range(3).select(F.col("id").alias("other")), "Three")
    report = store.report(one.revision_id, approximate=True, outliers=False)
    assert [tuple(r) for r in report.hints.collect()] == [(one.revision_id, two.revision_id, ["id", "name"])]
    assert report.columns.count() == 2
