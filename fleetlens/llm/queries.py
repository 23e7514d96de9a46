"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    filter_audit,
    fingerprints,
    jaccard_join,
    licenses,
    lm_scoring,
    packing,
    piece_coding,
    pii,
    quality_rules,
    secret_scan,
    sharding,
    suffix_dedup,
    vector_codes,
)
from fleetlens.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The key of the pseudonyms; a real one comes from a vault.
KEY = "a key for tests"


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@_query("op1_pack_documents")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(read(spark, sf_dir, "documents"), path)


@_query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_documents(read(spark, sf_dir, "documents"))


@_query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    target = labels.where(lm_scoring.good_documents(labels)).select("doc_id")
    return lm_scoring.score_documents(read(spark, sf_dir, "documents"), target)


@_query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query("op5_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize_documents(read(spark, sf_dir, "documents"), KEY)


@_query("op6_piece_coding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_coding.coded_documents(read(spark, sf_dir, "documents"), path)


@_query("op7_shard_documents")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@_query("op8_fingerprint_documents")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


@_query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


@_query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A document's path in its tree: source, language, id.
    placed = read(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return licenses.scan_documents(placed, "path")


@_query("op11_secret_scan")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(read(spark, sf_dir, "documents")))


@_query("op12_vector_codes", vector_codes.CODE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(read(spark, sf_dir, "embeddings"))


@_query("op13_filter_audit", filter_audit.AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
