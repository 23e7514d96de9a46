"""Sets of rows as hash tries: one digest for a set, and where two sets differ.

A row's place is given by the first hexadecimal digits of its hash, so the shape of a trie follows
from the number of rows alone: no order and no layout of the table plays a part. Leaves hold some
sixteen hashes and inner nodes sixteen digests; nothing larger meets in one group. Two sets of one
depth are compared leaf by leaf, and rows of equal leaves are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize


def row_hashes(rows: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """(keys, hash, copies): the hash of each different row of a key, and how often it is there.

    Hashes are kept as 32 bytes; as text they would be twice that wherever they are sent.
    """
    hashed = rows.select(*keys, F.unhex(F.sha2(row, 256)).alias("hash"))
    return hashed.groupBy(*keys, "hash").agg(F.count("*").alias("copies"))


def depths(sets: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, depth): digits of a leaf's place, so that the largest of the sets has sixteen rows a leaf."""
    sizes = [s.groupBy(*keys).agg(F.count("*").alias("n")) for s in sets]
    both = sizes[0]
    for more in sizes[1:]:
        both = both.unionByName(more)
    digits = F.length(F.hex(F.max("n") - 1)) - 1
    return both.groupBy(*keys).agg(digits.alias("depth"))


def _digits(hashes: Column | str) -> Column:
    return F.lower(F.hex(hashes))


def _digest(texts: Column) -> Column:
    return F.sha2(F.array_join(texts, ","), 256).alias("digest")


def _joined(text: Column) -> Column:
    return _digest(F.array_sort(F.collect_list(text)))


def leaves(hashed: DataFrame, depth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, depth, prefix, digest) of the leaves of each key."""
    place = F.substring(_digits("hash"), F.lit(1), F.col("depth"))
    placed = hashed.join(depth, list(keys)).withColumn("prefix", place)
    listed = F.array_sort(F.collect_list(F.struct("hash", "copies")))
    texts = F.transform(listed, lambda r: F.concat_ws(":", _digits(r["hash"]), r["copies"].cast("string")))
    return placed.groupBy(*keys, "depth", "prefix").agg(_digest(texts))


def root_digests(rows: DataFrame, keys: Sequence[str], row: Column) -> DataFrame:
    """(keys, digest): one hash of all rows of a key, each with its number of copies."""
    hashed = materialize(row_hashes(rows, keys, row), "row-hashes")
    depth = materialize(depths([hashed], keys), "depths")
    level = depth.agg(F.max("depth").alias("most")).first().most or 0
    nodes = materialize(leaves(hashed, depth, keys), "leaves")
    done = nodes.where("depth = 0").select(*keys, "digest")
    while level > 0:
        # Nodes of this level meet their parents; leaves that lie higher wait.
        here = F.length("prefix") == level
        digit = F.substring("prefix", F.lit(level), F.lit(1))
        parents = nodes.where(here).groupBy(*keys, "depth", F.substring("prefix", F.lit(1), F.lit(level - 1)).alias("prefix"))
        nodes = materialize(
            nodes.where(~here).unionByName(parents.agg(_joined(F.concat_ws(":", digit, "digest")))), "inner-nodes"
        )
        level -= 1
        done = nodes.where("prefix = ''").select(*keys, "digest")
    return done


def differing_rows(
    before: DataFrame, after: DataFrame, keys: Sequence[str], row: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, before, after): the leaves that differ, and the rows of both sides in them."""
    keys = list(keys)
    hashed = [materialize(row_hashes(side, keys, row), "row-hashes") for side in (before, after)]
    depth = materialize(depths(hashed, keys), "depths")
    one, two = (leaves(side, depth, keys).drop("depth") for side in hashed)
    changed = materialize(
        one.withColumnRenamed("digest", "digest_before")
        .join(two.withColumnRenamed("digest", "digest_after"), [*keys, "prefix"], "full")
        .where(~F.col("digest_before").eqNullSafe(F.col("digest_after"))),
        "differing-leaves",
    )

    def inside(side: DataFrame) -> DataFrame:
        placed = side.withColumn("_hash", F.sha2(row, 256)).join(depth, keys)
        prefix = F.substring("_hash", F.lit(1), F.col("depth"))
        return (
            placed.withColumn("prefix", prefix)
            .join(changed.select(*keys, "prefix"), [*keys, "prefix"], "left_semi")
            .select(*side.columns)
        )

    return changed, inside(before), inside(after)
