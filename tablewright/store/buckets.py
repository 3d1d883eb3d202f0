"""Keyed layouts: rows lie in buckets of their keys, so that a merge rewrites only buckets with changes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import RequestError
from tablewright.functions.columns import (
    ORDINAL,
    col,
    quoted,
    require,
    select_all,
    unused_name,
    visible,
)
from tablewright.operators.sets import row_digest
from tablewright.workspace import written

#: Buckets of a keyed dataset unless another number is asked for, and the most there can be: their
#: folders are listed in the driver.
BUCKETS, MOST_BUCKETS = 256, 4096


@dataclass(frozen=True)
class Layout:
    """The key columns of a dataset and the number of its buckets."""

    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        if not self.keys or len(set(self.keys)) < len(self.keys):
            raise RequestError("a keyed dataset needs different key columns", code="no_keys")
        if not 1 <= self.buckets <= MOST_BUCKETS:
            raise RequestError(f"buckets must be 1 to {MOST_BUCKETS}", code="bad_buckets")

    def to_json(self) -> str:
        return json.dumps({"keys": self.keys, "buckets": self.buckets})

    @classmethod
    def from_json(cls, text: str | None) -> Layout | None:
        if text is None:
            return None
        stored = json.loads(text)
        return cls(tuple(stored["keys"]), stored["buckets"])

    def digest(self, df: DataFrame) -> Column:
        """A stand-in for the keys of a row; NULL equals NULL in it."""
        require(df, self.keys)
        return row_digest(df, list(self.keys))

    def bucket(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(self.digest(df)), F.lit(self.buckets)).cast("int")


def write_buckets(df: DataFrame, layout: Layout, path: str, first: int) -> tuple[DataFrame, str]:
    """Write rows into folders of their buckets; gives the written rows and the folders' column.

    Spark evens out the tasks by size, so a bucket with a hot key is many files and small buckets
    share a task.  Within a task rows keep the order in which they arrived, new ones last; row ids
    start at ``first``.
    """
    name = unused_name(df, "bucket_no")
    rows = df.withColumn(name, layout.bucket(df)).hint("rebalance", F.col(name))
    order = [F.col(name)]
    if ORDINAL in df.columns:
        order.append(F.col(ORDINAL).asc_nulls_last())
    rows = rows.sortWithinPartitions(*order).withColumn(
        ORDINAL, F.monotonically_increasing_id() + F.lit(first)
    )
    rows.write.partitionBy(name).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path), name


@dataclass(frozen=True)
class Changes:
    """One row per key in the shared folder: the columns of the dataset, and what becomes of the key."""

    rows: DataFrame
    digest: str
    bucket: str
    deleted: str


def latest_changes(
    changes: DataFrame,
    target: DataFrame,
    layout: Layout,
    delete: str | Column | None,
    order_by: Sequence[str],
) -> Changes:
    """Check the changes against the dataset's columns, and keep the last one of each key.

    Columns are matched by name and must have the dataset's types; further ones may be used by
    ``delete`` and ``order_by``.  A key that comes twice is an error unless ``order_by`` says which
    change is the last; if that is undecided, it is the one with the greater digest of the row.
    """
    names = visible(target)
    require(changes, [*names, *order_by])
    types = {f.name: f.dataType for f in changes.schema.fields}
    wrong = [f.name for f in target.schema.fields if f.name in names and types[f.name] != f.dataType]
    if wrong:
        raise RequestError(f"other types than the dataset's: {', '.join(wrong)}", code="different_columns")
    digest, bucket, deleted, row, rank = (
        unused_name(target, n) for n in ("key_digest", "key_bucket", "deleted", "row", "rank")
    )
    condition = F.expr(delete) if isinstance(delete, str) else F.lit(False) if delete is None else delete
    flat = changes.select(
        layout.digest(changes).alias(digest),
        layout.bucket(changes).alias(bucket),
        F.coalesce(condition, F.lit(False)).alias(deleted),
        F.struct(*select_all(names)).alias(row),
        F.struct(*[col(changes, n) for n in order_by], row_digest(changes, names)).alias(rank),
    )
    last = flat.groupBy(digest).agg(
        F.max_by(F.struct(bucket, deleted, row), rank).alias("last"), F.count(F.lit(1)).alias("n")
    )
    kept = written(
        last.select(
            digest, "n", f"last.{bucket}", f"last.{deleted}",
            *[F.col(f"last.{row}.{quoted(n)}").alias(n) for n in names],
        ),
        "changes",
    )
    if not order_by and kept.filter("n > 1").limit(1).count():
        raise RequestError("a key has several changes and no order", code="repeated_key")
    return Changes(kept, digest, bucket, deleted)


def merged(rows: DataFrame, changes: Changes, layout: Layout) -> DataFrame:
    """``rows`` with ordinals, those with a changed key replaced; what is new has no ordinal yet."""
    names, key = visible(rows), changes.digest
    marked = rows.withColumn(key, layout.digest(rows))
    stay = marked.join(changes.rows.select(key), key, "left_anti")
    new = changes.rows.filter(~F.col(changes.deleted))
    return stay.select(*select_all([*names, ORDINAL])).unionByName(
        new.select(*select_all(names), F.lit(None).cast("bigint").alias(ORDINAL))
    )
