"""Ordered computations that stay parallel when one key holds most of the rows.

A plain window puts a whole key into one task. The helpers here cut a key into ordered
pieces, work inside the pieces and carry one small row per piece across them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize

SEQUENCE_WIDTH = 1 << 20


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    weight: Column | None = None,
) -> DataFrame:
    """Add `out`, the inclusive running sum of `weight` per key in `order`.

    The rows are range partitioned by key and order, so a hot key spans many partitions.
    The layout is written once: partition numbers must not change between the pass that
    sums whole partitions and the pass that sums inside them.
    """
    keys = list(keys)
    weighted = df.withColumn("_weight", F.lit(1).cast("long") if weight is None else weight)
    laid = materialize(
        weighted.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()),
        "ordered",
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*keys, "_part")
        .agg(F.sum("_weight").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .select(*keys, "_part", "_before")
    )
    inside = (
        Window.partitionBy(*keys, "_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        laid.withColumn("_inside", F.sum("_weight").over(inside))
        .join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_part", "_before", "_inside", "_weight")
    )


def position_by_sequence(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    out: str,
    width: int = SEQUENCE_WIDTH,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Add `out`, the 1-based position inside the key, ordered by a whole-number column.

    The order column itself names the piece (`sequence div width`), so nothing is written.
    Rows of equal sequence follow in the order of `ties`; few share a number, which bounds a
    piece to about `width` rows.
    """
    keys = list(keys)
    laid = df.withColumn("_piece", F.floor(F.col(sequence) / width))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*keys, "_piece")
        .agg(F.count("*").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .select(*keys, "_piece", "_before")
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(sequence, *ties)
    return (
        laid.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_piece"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_piece", "_before", "_inside")
    )


def piece_width(
    df: DataFrame, keys: Sequence[str], sequence: str, rows: int = SEQUENCE_WIDTH
) -> int | None:
    """The width of pieces that hold `rows` rows of a key at most; null if no key has more.

    Numbers may lie far apart, so that the number of rows in a piece does not follow from its
    width. It is divided until the fullest piece is small enough; one of `rows` always is, as far
    as numbers are unique.
    """
    df = df.dropna(subset=[*keys, sequence])
    least, most, fullest = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min(sequence).alias("_least"), F.max(sequence).alias("_most"))
        .agg(F.min("_least"), F.max("_most"), F.max("_n"))
        .first()
    )
    if fullest is None or fullest <= rows:
        return None
    width = most - least + 1
    while fullest > rows and width > rows:
        width = max(rows, width // max(2, min(16, 2 * fullest // rows)))
        fullest = (
            df.groupBy(*keys, F.floor(F.col(sequence) / width).alias("_piece")).count().agg(F.max("count")).first()[0]
        )
    return width


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    value: Column,
    out: str,
    width: int | None = SEQUENCE_WIDTH,
) -> DataFrame:
    """Add `out`, the last non-null `value` strictly before this row inside the key.

    The order column is a whole number and unique inside the key. Without `width` a key is one
    piece; see `piece_width`.
    """
    keys = list(keys)
    if width is None:
        whole = Window.partitionBy(*keys).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(whole))
    laid = df.withColumn("_piece", F.floor(F.col(sequence) / width)).withColumn("_value", value)
    earlier = (
        Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    kept = F.struct(sequence, F.struct(F.col("_value").alias("v")).alias("s"))
    edges = (
        laid.groupBy(*keys, "_piece")
        .agg(F.max(F.when(F.col("_value").isNotNull(), kept)).alias("_last"))
        .withColumn("_far", F.last("_last", ignorenulls=True).over(earlier))
        .select(*keys, "_piece", F.col("_far.s.v").alias("_far"))
    )
    inside = (
        Window.partitionBy(*keys, "_piece")
        .orderBy(sequence)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        laid.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
        .join(edges, [*keys, "_piece"])
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_piece", "_value", "_near", "_far")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    fields: Sequence[str],
    out: str,
    width: int = SEQUENCE_WIDTH,
) -> DataFrame:
    """Add `out`, a struct of `fields` from the row right before this one inside the key."""
    return carry_forward(df, keys, sequence, F.struct(*fields), out, width)
