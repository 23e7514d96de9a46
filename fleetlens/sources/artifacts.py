"""Artifact documents: canonical JSON lines with their hash, partitioned by application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions.identity import canonical_json, sha256_text


def write_artifacts(documents: DataFrame, path: str) -> None:
    """Write each row as one canonical JSON document with its hash.

    `documents` holds app_id, artifact_type and the payload columns. The commit protocol of the
    write makes the result appear whole or not at all.
    """
    payload = [c for c in documents.columns if c not in ("app_id", "artifact_type")]
    (
        documents.select("app_id", "artifact_type", canonical_json(*payload).alias("document"))
        .withColumn("content_hash", sha256_text("document"))
        .write.mode("overwrite")
        .partitionBy("app_id")
        .parquet(path)
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts below `path`; a filter on app_id reads only that application's folder."""
    schema = "artifact_type string, document string, content_hash string, app_id string"
    return spark.read.schema(schema).parquet(path)
