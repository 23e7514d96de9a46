"""Durable intermediate tables.

Intermediate results that are read more than once are written below the shared folder the
cluster names in ``spark.checkpoint.dir``, so a lost executor never forces a different
recomputation. A local folder is used only when the setting is missing and the master is
local, which is the case in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables of this session."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_SETTING} must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(_SETTING, folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and return it as a table scan with its lineage cut."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
