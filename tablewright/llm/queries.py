"""The queries of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import oracles
from tablewright.llm.additive_quality import AdditiveModel, fit_quality, score_quality
from tablewright.llm.ball_tree import top_products
from tablewright.llm.binary_packing import pack_documents
from tablewright.llm.disclosure import KINDS, all_spans, find_personal, joined_spans
from tablewright.llm.lattice_dedup import near_vectors
from tablewright.llm.line_dedup import drop_repeated_lines
from tablewright.llm.lockstep_alignment import align_tokens
from tablewright.llm.merkle_strings import tamper_check
from tablewright.llm.pfair import mix_sources
from tablewright.llm.prob_minhash import near_duplicates
from tablewright.llm.rank_profiles import fit_languages, held_out, identify_languages
from tablewright.llm.shared import importable
from tablewright.llm.trie_counts import count_tokens
from tablewright.llm.url_terms import judge_urls

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_PATTERN = public_tokenizers.PATTERN
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class LlmQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return self.build(spark, folder)


REGISTRY: dict[str, LlmQuery] = {}


def query(sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[build.__name__] = LlmQuery(build, sql)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(oracles.LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal(table(spark, folder, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined_spans(F.col("spans")), 256).alias("base_sha256"),
        joined_spans(all_spans(F.col("spans"), F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query()
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), BYTE_RANKS, BYTE_PATTERN, with_ids=False)


def quality_model(spark: SparkSession, folder: str) -> AdditiveModel:
    """The classifier as the query and the pipeline use it, fitted on the given labels."""
    return fit_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_quality(docs, quality_model(spark, folder)).drop("text")


@query()
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query(oracles.PFAIR)
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents").select("doc_id", "source"))


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents").select("doc_id", "text"), PIECE_MODEL).drop("text")


@query(oracles.TOP_PRODUCTS)
def op8_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(table(spark, folder, "embeddings"))


@query(oracles.NEAR_VECTORS)
def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query(oracles.url_terms())
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages").select("page_id", "url")).drop("url")


@query()
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokens(table(spark, folder, "documents"), BYTE_RANKS, BYTE_PATTERN, PIECE_MODEL)[0]


@query(oracles.MERKLE)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return tamper_check(table(spark, folder, "documents"))


@query()
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    other = held_out(F.col("doc_id"), 4, 2)
    model = fit_languages(docs.filter(~other))
    return identify_languages(docs.select("doc_id", "text", other.alias("held_out")), model).drop("text")
