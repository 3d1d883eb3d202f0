"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes what a stage
returns as Parquet in the shared folder and gives the next one what it reads from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.additive_quality import fit_quality, keep_good
from tablewright.llm.binary_packing import pack_documents
from tablewright.llm.line_dedup import drop_repeated_lines
from tablewright.llm.pfair import in_order, mix_sources, with_written_place, written_row
from tablewright.llm.prob_minhash import keep_one
from tablewright.llm.queries import BYTE_PATTERN, BYTE_RANKS, LlmQuery, table
from tablewright.llm.queries import REGISTRY as _QUERIES
from tablewright.llm.shared import free_name, importable
from tablewright.workspace import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the given labels, does not reject."""
    importable(spark)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others repeat; ``n_chars`` follows the text."""
    importable(spark)
    cleaned = drop_repeated_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    importable(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture."""
    importable(spark)
    tie = written_row(docs) if docs.inputFiles() else None
    return in_order(mix_sources(docs, tie=tie), docs.columns, docs.count())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, with their ids, numbered in the order in which mixing wrote the documents.

    Documents that come from no files are numbered as they come.
    """
    importable(spark)
    if not docs.inputFiles():
        return pack_documents(docs, BYTE_RANKS, BYTE_PATTERN, with_ids=True)
    place = free_name(docs, "mix_place")
    return pack_documents(with_written_place(docs, place), BYTE_RANKS, BYTE_PATTERN, with_ids=True, place=place)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


REGISTRY = _QUERIES | {"pipeline": LlmQuery(run, ORACLE_SQL)}
