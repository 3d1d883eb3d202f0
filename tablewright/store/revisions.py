"""Versioned datasets: every import and every cleaning run is an immutable Parquet table.

Below the store's root lie ``data/rev_<id>`` with the rows, ``parts/rev_<id>`` with the row counts of
their parts, ``profiles/rev_<id>`` and ``sketches/rev_<id>`` with cached profiles, and
``catalog/dataset=<id>`` with one small file per revision.  A revision exists once its catalog entry
does, so a job that fails or loses its driver leaves nothing visible.  Names given by users live in
the catalog only.

The rows of a keyed dataset lie in folders, one per bucket of its keys.  ``places/rev_<id>`` lists the
folders of a revision, those it shares with its parent among them.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import RequestError
from tablewright.functions.columns import (
    ORDINAL,
    field_logical_type,
    quoted,
    unused_name,
    visible,
)
from tablewright.operators import lineage, paging, sketches
from tablewright.operators.catalog import relationship_hints
from tablewright.plans.pipeline import CleaningPipeline
from tablewright.plans.profile import ProfileReport, profile_report
from tablewright.store.buckets import (
    BUCKETS,
    Layout,
    latest_changes,
    merged,
    write_buckets,
)

_CATALOG = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("revision_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("label", T.StringType()),
        T.StructField("columns", T.StringType()),
        T.StructField("pipeline", T.StringType()),
        T.StructField("layout", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Revision:
    """The catalog entry of one revision."""

    dataset_id: str
    alias: str
    revision_id: str
    parent_id: str | None
    label: str
    pipeline: str | None = None
    layout: str | None = None


class RevisionStore:
    """Datasets below one root folder, which all executors must be able to reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # --- writing ---------------------------------------------------------------------------

    def import_table(
        self,
        df: DataFrame,
        alias: str = "Dataset",
        *,
        keys: Sequence[str] = (),
        buckets: int = BUCKETS,
    ) -> Revision:
        """Store a table as the first revision of a new dataset.

        With ``keys`` its rows lie in buckets of them, ready for merges; they are then in the order of
        their buckets.  A column with the name under which stored tables keep the order of arrival
        gets another.
        """
        for taken in [n for n in df.columns if n.lower() == ORDINAL]:
            df = df.withColumnRenamed(taken, unused_name(df, ORDINAL))
        new = Revision(uuid.uuid4().hex, alias, uuid.uuid4().hex, None, "import")
        if keys:
            return self._add_keyed(df, new, Layout(tuple(keys), buckets))
        return self._add(df, new)

    def import_merge(
        self,
        dataset_id: str,
        changes: DataFrame,
        keys: Sequence[str],
        *,
        delete: str | Column | None = None,
        order_by: Sequence[str] = (),
        buckets: int = BUCKETS,
    ) -> Revision:
        """Store the current revision with changed rows put in, as its child.

        A change replaces all rows with its keys, or is added where there are none; where ``delete``
        holds, they go.  NULL equals NULL in keys.  A key that comes twice is an error, unless
        ``order_by`` (columns of the changes) says which is the last.

        Only buckets that a change falls into are read and written; the files of the others belong to
        both revisions.  If the dataset is not yet keyed so, all of it is written, into ``buckets``.
        """
        parent = self.current(dataset_id)
        before = self.read(parent.revision_id, ordinal=True)
        layout = Layout.from_json(parent.layout)
        keyed = layout is not None and set(layout.keys) == set(keys)
        if not keyed:
            layout = Layout(tuple(keys), buckets)
        latest = latest_changes(changes, _storable(before), layout, delete, order_by)
        new = Revision(dataset_id, parent.alias, uuid.uuid4().hex, parent.revision_id, "merge")
        if not keyed:
            return self._add_keyed(merged(before, latest, layout), new, layout)
        touched = {r[0] for r in latest.rows.select(latest.bucket).distinct().collect()}
        places = self._places(parent.revision_id)
        before = self._at({b: p for b, p in places.items() if b in touched}, parent.revision_id)
        kept = {b: p for b, p in places.items() if b not in touched}
        parts = self.spark.read.parquet(self._path("parts", parent.revision_id))
        return self._add_keyed(merged(before, latest, layout), new, layout, kept, parts)

    def apply_cleaning(self, dataset_id: str, pipeline: CleaningPipeline) -> Revision:
        """Run a pipeline on the current revision and store the result as its child."""
        parent = self.current(dataset_id)
        cleaned = pipeline.apply(self.read(parent.revision_id, ordinal=True))
        new = Revision(
            dataset_id, parent.alias, uuid.uuid4().hex, parent.revision_id, "clean", pipeline.to_json()
        )
        return self._add(cleaned, new)

    def _add(self, df: DataFrame, new: Revision) -> Revision:
        rows = _storable(df.select(*[F.col(quoted(n)) for n in visible(df)]))
        path = self._path("data", new.revision_id)
        # Rows are numbered as they are written; how many each part holds is then read back from
        # that one column, so the data itself is written once and never re-read.
        paging.with_ordinal(rows).write.parquet(path)
        stored = self.spark.read.parquet(path)
        paging.part_starts(stored).coalesce(1).write.parquet(self._path("parts", new.revision_id))
        return self._enter(new, rows.schema)

    def _add_keyed(
        self,
        df: DataFrame,
        new: Revision,
        layout: Layout,
        kept: Mapping[int, str] | None = None,
        parts: DataFrame | None = None,
    ) -> Revision:
        """Store rows by bucket, beside the folders ``kept`` from the parent with its ``parts``."""
        rows = _storable(df)
        path, places = self._path("data", new.revision_id), self._path("places", new.revision_id)
        first = 0 if parts is None else paging.next_part(parts)
        stored, name = write_buckets(rows, layout, path, first)
        counts = paging.part_counts(stored, name).withColumnRenamed(name, "bucket")
        if parts is not None:
            old = parts.filter(F.col("bucket").isin(list(kept))).select(counts.columns)
            counts = counts.unionByName(old)
        listed = self._path("parts", new.revision_id)
        paging.with_starts(counts).coalesce(1).write.parquet(listed)
        filled = self.spark.read.parquet(listed).select("bucket").distinct().collect()
        folders = {r[0]: (kept or {}).get(r[0], f"{path}/{name}={r[0]}") for r in filled}
        plain = rows.select(*[F.col(quoted(n)) for n in visible(rows)])
        paging.with_ordinal(plain).limit(0).coalesce(1).write.parquet(f"{places}/schema")
        self.spark.createDataFrame(sorted(folders.items()), "bucket int, place string").coalesce(
            1
        ).write.parquet(f"{places}/folders")
        new = replace(new, layout=layout.to_json())
        return self._enter(new, plain.schema)

    def _enter(self, new: Revision, schema: T.StructType) -> Revision:
        columns = [
            {
                "name": f.name,
                "logical_type": field_logical_type(f),
                "nullable": f.nullable,
                "override": bool((f.metadata or {}).get("override")),
            }
            for f in schema.fields
        ]
        entry = (
            new.dataset_id,
            new.alias,
            new.revision_id,
            new.parent_id,
            dt.datetime.now(dt.UTC),
            new.label,
            json.dumps(columns),
            new.pipeline,
            new.layout,
        )
        self.spark.createDataFrame([entry], _CATALOG).coalesce(1).write.parquet(
            f"{self.root}/catalog/dataset={new.dataset_id}/entry={new.revision_id}"
        )
        return new

    # --- reading ---------------------------------------------------------------------------

    def catalog(self, dataset_id: str | None = None) -> DataFrame:
        """One row per revision, of all datasets or of one, whose entries alone are read then."""
        folder = f"{self.root}/catalog"
        if dataset_id is not None:
            # Ids are made here; nothing else may become part of a path.
            if not re.fullmatch("[0-9a-f]{32}", dataset_id):
                raise RequestError(f"no such dataset: {dataset_id}", code="dataset_missing")
            folder += f"/dataset={dataset_id}"
        try:
            return self.spark.read.schema(_CATALOG).option("recursiveFileLookup", True).parquet(folder)
        except AnalysisException:
            if dataset_id is None:
                raise
            raise RequestError(f"no such dataset: {dataset_id}", code="dataset_missing") from None

    def current(self, dataset_id: str) -> Revision:
        """The newest revision of a dataset."""
        found = (
            self.catalog(dataset_id).orderBy(F.col("created_at").desc(), "revision_id").head()
        )
        if found is None:
            raise RequestError(f"no such dataset: {dataset_id}", code="dataset_missing")
        return Revision(
            found["dataset_id"],
            found["alias"],
            found["revision_id"],
            found["parent_id"],
            found["label"],
            found["pipeline"],
            found["layout"],
        )

    def read(self, revision_id: str, ordinal: bool = False) -> DataFrame:
        """The rows of a revision, with the hidden arrival order on request."""
        places = self._places(revision_id)
        if places is None:
            df = self.spark.read.parquet(self._path("data", revision_id))
        else:
            df = self._at(places, revision_id)
        return df if ordinal else df.drop(ORDINAL)

    def _places(self, revision_id: str) -> dict[int, str] | None:
        """The folders of a keyed revision by bucket, MOST_BUCKETS at most; None for other revisions."""
        try:
            listed = self.spark.read.parquet(f"{self._path('places', revision_id)}/folders")
        except AnalysisException:
            return None
        return {r["bucket"]: r["place"] for r in listed.collect()}

    def _at(self, places: Mapping[int, str], revision_id: str) -> DataFrame:
        """The rows in some folders of a keyed revision."""
        schema = self.spark.read.parquet(f"{self._path('places', revision_id)}/schema").schema
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*places.values())

    def page(
        self,
        revision_id: str,
        offset: int = 0,
        limit: int = 500,
        order_by: str | None = None,
        descending: bool = False,
    ) -> DataFrame:
        """A window of rows, in order of arrival or sorted by a column."""
        df = self.read(revision_id, ordinal=True)
        if order_by is None:
            starts = self.spark.read.parquet(self._path("parts", revision_id))
            page = paging.page_by_position(df, starts, offset, limit)
        else:
            page = paging.sorted_page(df, order_by, offset, limit, descending=descending)
        return page.drop(ORDINAL)

    def row_count(self, revision_id: str) -> int:
        """From the part counts, without touching the data."""
        parts = self.spark.read.parquet(self._path("parts", revision_id))
        return parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).head()[0]

    def lineage(self, dataset_id: str) -> DataFrame:
        """Every revision of a dataset with its root and its depth below it."""
        return lineage.revision_lineage(self.catalog(dataset_id))

    def profile(
        self,
        revision_id: str,
        *,
        sample_rows: int | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Column profiles and table summary, computed once per revision and then re-read.

        A profile of a sample is kept beside the full one, for each size that was asked for.
        """
        kind = "full" if sample_rows is None else f"sample_{sample_rows}"
        place = f"{self._path('profiles', revision_id)}/{kind}"
        kept = self._kept_profile(place)
        if kept is None:
            report = profile_report(self.read(revision_id, ordinal=True), sample_rows=sample_rows)
            report.columns.coalesce(1).write.mode("overwrite").parquet(f"{place}/columns")
            report.summary.coalesce(1).write.mode("overwrite").parquet(f"{place}/summary")
            kept = self._kept_profile(place)
        return kept

    def report(self, revision_id: str, **options: Any) -> ProfileReport:
        """A fresh report with any options of ``profile_report``, and the hints the catalog gives.

        Hints name the datasets whose current revisions share columns with this one.
        """
        report = profile_report(self.read(revision_id, ordinal=True), **options)
        return replace(report, hints=self.hints(revision_id)) if report.hints is None else report

    def hints(self, revision_id: str) -> DataFrame:
        """Current revisions of other datasets with columns of the same names: ``left_table`` (this
        revision), ``right_table`` (theirs) and ``shared_columns``.  Read from the catalog alone."""
        newest = Window.partitionBy("dataset_id").orderBy(F.col("created_at").desc(), "revision_id")
        catalog = self.catalog().withColumn("age", F.row_number().over(newest))
        own = catalog.filter(F.col("revision_id") == revision_id).select(F.col("dataset_id").alias("own_id"))
        others = catalog.filter("age = 1").join(own, F.col("dataset_id") == F.col("own_id"), "left_anti")
        mine = catalog.filter(F.col("revision_id") == revision_id)
        described = mine.unionByName(others).select(
            F.col("revision_id").alias("table_name"),
            F.explode(F.from_json("columns", "array<struct<name string>>").getField("name")).alias("column_name"),
        )
        return relationship_hints(described).filter(F.col("left_table") == revision_id)

    def sketch(self, revision_id: str) -> DataFrame:
        """The profile of a revision from sketches that are kept with it.

        A keyed revision keeps one set per bucket and takes those of the buckets it shares with its
        parent from there, so that after a merge only rewritten buckets are read.
        """
        kept = self._path("sketches", revision_id)
        try:
            return sketches.merged(self.spark.read.parquet(kept))
        except AnalysisException:
            pass
        places = self._places(revision_id)
        if not places:  # not keyed, or without rows
            parts = sketches.sketched(self.read(revision_id)).withColumn("place", F.lit(None).cast("string"))
        else:
            parts = self._sketched_buckets(revision_id, places)
        parts.write.mode("overwrite").parquet(kept)
        return sketches.merged(self.spark.read.parquet(kept))

    def _sketched_buckets(self, revision_id: str, places: Mapping[int, str]) -> DataFrame:
        entry = self.catalog().filter(F.col("revision_id") == revision_id).select("parent_id", "layout").head()
        layout, inherited, have = Layout.from_json(entry["layout"]), None, set()
        try:
            above = self.spark.read.parquet(self._path("sketches", entry["parent_id"] or ""))
            inherited = above.filter(F.col("place").isin(list(places.values())))
            have = {r[0] for r in inherited.select("place").distinct().collect()}
        except AnalysisException:
            pass
        missing = {b: p for b, p in places.items() if p not in have}
        rows = self._at(missing, revision_id).drop(ORDINAL)
        folders = self.spark.createDataFrame(list(missing.items()), "by0 int, place string")
        fresh = sketches.sketched(rows, layout.bucket(rows)).join(F.broadcast(folders), "by0").drop("by0")
        return fresh if inherited is None else fresh.unionByName(inherited)

    def _kept_profile(self, place: str) -> tuple[DataFrame, DataFrame] | None:
        try:
            # The summary is written last, so where it can be read the columns are complete.
            summary = self.spark.read.parquet(f"{place}/summary")
        except AnalysisException:
            return None
        return self.spark.read.parquet(f"{place}/columns"), summary

    def _path(self, kind: str, revision_id: str) -> str:
        return f"{self.root}/{kind}/rev_{revision_id}"


def _storable(df: DataFrame) -> DataFrame:
    """Columns without a type of their own, from empty sources, are stored as text."""
    untyped = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    return df.withColumns({n: F.col(quoted(n)).cast("string") for n in untyped})
