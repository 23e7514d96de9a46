"""A training corpus from raw documents: filter, deduplicate, pseudonymize, pack.

Every stage takes all documents that the one before it kept. All but the last return the columns
of `documents`; a stage that changes texts brings `n_chars` up to date.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import jaccard_join, packing, pii, quality_rules, suffix_dedup
from fleetlens.llm.common import read
from fleetlens.llm.queries import KEY
from fleetlens.sources.scratch import materialize


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality_rules.kept_documents(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near-duplicates."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur more than once."""
    return _measured(suffix_dedup.without_repeats(docs))


def hide_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for valid private values."""
    return _measured(pii.private_documents(docs, KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", filter_quality),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("pseudonyms", hide_private_values),
    ("packing", pack),
]

#: The learned list, the components and the packing have no form in SQL; tests/llm checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over `documents`; what stands between stages is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
