"""Lines repeated across documents: levelled sorted runs of line hashes.

An index of lines is kept like a log-structured merge tree.  Documents arrive in batches.  A batch
is reduced to one row per line key (how many of its documents hold it, the largest of their ids),
hashed to buckets and sorted; a merge anti-join with each run already there splits it into keys
never seen, which become a new run of level 0, and keys seen before, which go to a log of repeats.
When a level has ``fan_in`` runs they are merged into one of the next level, so a key is rewritten
once per level.  Runs share no key, hence merging is a union and no aggregation.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.shared import c, free_name, text_batches, whole_text
from tablewright.workspace import new_folder, written

# What is stripped from both ends of a line before it is compared.
_BLANK = b" \t\n\x0b\x0c\r"

MIN_LENGTH = 40
MIN_DOCS = 5
#: Batches at least, so that later ones meet compacted runs, and documents of a batch at most.
BATCHES = 6
BATCH_DOCS = 1 << 25
#: Runs of a level that become one of the next.
FAN_IN = 3
#: Parts into which the lines of one key are dealt when they meet the list of repeated keys.
SALTS = 16


def line_key(line: bytes, min_length: int) -> bytes | None:
    """The hash of a line's key; None for lines too short to count."""
    key = line.strip(_BLANK).lower()  # bytes.lower() changes A-Z alone
    if len(key) < min_length or len(key.decode("utf-8", "replace")) < min_length:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class LineRuns:
    """The runs below one folder of the shared storage.

    Runs are tables bucketed and sorted by key, so that neither merging them nor joining a batch
    with them shuffles what they hold.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark = spark
        self.fan_in = fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []

    def add(self, keys: DataFrame) -> None:
        """Take in a batch: ``(key, doc_id)``, one row per key and document.

        A document must not be spread over batches.
        """
        fresh = written(
            keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last_doc")),
            "batch",
        )
        batch = fresh
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).select("key"), "key", "left_anti")
        if any(self.levels):
            self._keep(fresh, 0)
            added = self.spark.table(self.levels[0][-1]).select("key")
            self.repeats.append(batch.join(added, "key", "left_anti"))
        else:
            self._keep(fresh, 0)
        self._compact()

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def repeated(self, min_docs: int) -> DataFrame:
        """``(key, last_doc)`` of the keys that at least ``min_docs`` documents hold."""
        seen = [self.spark.table(name) for name in self.runs()]
        rows = seen[0]
        for other in [*seen[1:], *self.repeats]:
            rows = rows.unionByName(other)
        return (
            rows.groupBy("key")
            .agg(F.sum("docs").alias("docs"), F.max("last_doc").alias("last_doc"))
            .filter(F.col("docs") >= min_docs)
            .select("key", "last_doc")
        )

    def drop(self) -> None:
        """Forget the runs' names; their files stay in the shared folder for readers under way."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _keep(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.select("key", "docs", "last_doc")
            .repartition(self.buckets, "key")
            .write.bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", new_folder(self.spark, "line-run"))
            .saveAsTable(name)
        )
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            names, self.levels[level] = self.levels[level], []
            merged = self.spark.table(names[0])
            for name in names[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self._keep(merged, level + 1)
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            level += 1


def _keys_of(min_length: int):
    def keys(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_batches(tables):
            ids, out = [], []
            for doc, text in zip(table.column(0).to_pylist(), _text_bytes(table.column(1)), strict=True):
                found = {k for line in text.split(b"\n") if (k := line_key(line, min_length)) is not None}
                ids += [doc] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "key"])

    return keys


def _cleaner(min_length: int):
    def clean(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, keys in zip(text, dropped, strict=True):
            lines = whole.split("\n")
            n = len(lines)
            if keys is not None and len(keys):
                gone = set(keys)
                lines = [x for x in lines if line_key(x.encode(), min_length) not in gone]
                whole = "\n".join(lines)
            rows.append((whole, n, n - len(lines)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    return F.pandas_udf(clean, "text string, n_lines long, n_dropped long")


def drop_repeated_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_docs: int = MIN_DOCS,
    batches: int | None = None,
    fan_in: int = FAN_IN,
    counts: bool = True,
) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents or more hold, but for one document.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lowered.  Keys of at
    least ``min_length`` code points in at least ``min_docs`` documents lose their lines everywhere
    except in the document with the largest id that holds them, which keeps all of them; other
    lines stay as they are.  ``counts`` adds ``n_lines`` and ``n_dropped``, replacing columns of
    those names.

    Null and empty texts are one empty line and come back empty.  Rows with the same id are one
    document: it counts once, and each of its rows is cleaned.  A null id is a document of its own
    that is smaller than all others.  An empty table gives an empty one.

    Documents come in ``batches`` by a hash of their ids, by default as many as ``BATCH_DOCS`` asks for.
    The text is read twice, and joined on the document's id to its repeated keys only; every other
    shuffle moves 16-byte hashes and ids.  A key that a third of all rows holds is one row per run,
    and its lines are dealt over ``SALTS`` parts when they meet the list of repeated keys.
    """
    spark = docs.sparkSession
    if batches is None:
        batches = max(BATCHES, -(-docs.count() // BATCH_DOCS))
    # The smallest long stands for a null id, so that ids can be grouped and joined plainly.
    ident = F.coalesce(c(doc_id).cast("long"), F.lit(-(2**63)))
    pairs = docs.select(ident.alias("doc_id"), whole_text(text).alias("text")).mapInArrow(
        _keys_of(min_length), "doc_id long, key binary"
    )
    folder = new_folder(spark, "line-keys")
    (
        pairs.distinct()
        .withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
        .write.partitionBy("batch")
        .parquet(folder)
    )
    lines = spark.read.schema("doc_id long, key binary, batch int").parquet(folder)
    index = LineRuns(spark, fan_in)
    for b in range(batches):
        index.add(lines.filter(F.col("batch") == b).select("key", "doc_id"))
    repeated = written(index.repeated(min_docs), "repeated-lines")
    index.drop()
    # Their estimated size leaves the copies out, so they must not be broadcast by it.
    salted = repeated.hint("merge").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = (
        lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)).cast("int"))
        .join(salted, ["key", "salt"])
        .filter("doc_id <> last_doc")
        .groupBy(F.col("doc_id").alias("_gone_id"))
        .agg(F.collect_list("key").alias("_gone"))
    )
    mine, keys, out = (free_name(docs, x) for x in ("line_doc", "line_keys", "line_result"))
    gone = gone.select(F.col("_gone_id").alias(mine), F.col("_gone").alias(keys))
    cleaned = (
        docs.withColumn(mine, ident)
        .join(gone, mine, "left")
        .withColumn(out, _cleaner(min_length)(whole_text(text), c(keys)))
    )
    new = {"n_lines", "n_dropped"} if counts else set()
    columns = [
        F.col(f"`{out}`.text").alias(text) if n == text else c(n) for n in docs.columns if n.lower() not in new
    ]
    if counts:
        columns += [F.col(f"`{out}`.n_lines").alias("n_lines"), F.col(f"`{out}`.n_dropped").alias("n_dropped")]
    return cleaned.select(*columns)
