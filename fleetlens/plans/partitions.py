"""How rows are laid out before work that is dear for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, where it has fewer.

    A table of one small file is read by one task however much work its rows make. Larger tables
    have more partitions than cores and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Files of few row groups have fewer partitions with rows than they have splits.
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly, over as many partitions as it has, and as there are cores at least.

    For rows that a filter leaves in a few partitions of a table.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
