"""What several operators of this subpackage share: inputs, keys, row numbers, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize

#: White space that parts words: blank and the control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, a null text as the empty one; whatever else `docs` holds stays out."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes under different seeds; together they name a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")


def portions(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with at most `limit` bytes of text in `column`, or one row."""
    sizes = np.fromiter((n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()), dtype=np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if batch.num_rows > first:
        yield batch.slice(first)


def number_rows(rows: DataFrame, order: Sequence[str], label: str) -> tuple[DataFrame, int]:
    """`rows` with `row`, their place from 0 in `order`, and how many there are.

    The sorted layout is written once, so numbers stay as they are when a task runs again. Only
    one count for each partition is broadcast, which the number of partitions bounds.
    """
    laid = materialize(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = (
        laid.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("row", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )
    return numbered, laid.count()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the least node of the connected component of each node of `edges`.

    `edges` has u and v of one orderable type. Each round takes the least label among the
    neighbours and then the label of that label, so long chains shrink by halves; a node with
    very many neighbours only meets a minimum, which is combined before the shuffle.
    """
    both = materialize(
        edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(),
        f"{label}-edges",
    )
    labels = materialize(
        both.groupBy("u").agg(F.min("v").alias("_least")).select(
            F.col("u").alias("node"), F.least("u", "_least").alias("component")
        ),
        f"{label}-labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy("u")
            .agg(F.min("component").alias("_near"))
            .withColumnRenamed("u", "node")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        stepped = (
            labels.join(near, "node")
            .join(jump, "component", "left")
            .select(
                "node",
                F.col("component").alias("_old"),
                F.least("component", "_near", "_far").alias("component"),
            )
        )
        stepped = materialize(stepped, f"{label}-labels")
        labels = stepped.drop("_old")
        if stepped.where("_old <> component").isEmpty():
            return labels
