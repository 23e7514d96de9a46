"""Reproducible shards: a keyed Feistel permutation with cycle walking over row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import number_rows, texts_of

ROUNDS = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sides(n: int) -> tuple[np.uint64, np.uint64]:
    left = math.isqrt(max(n - 1, 0)) + 1
    return np.uint64(left), np.uint64(-(-n // left))


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number below `n` under the permutation of `seed`, or the way back.

    A number is a pair (left, right) on a grid of at least `n` cells; rounds add a keyed mix of
    one half to the other. A result outside of 0..n-1 is permuted again until it lies inside.
    """
    left_side, right_side = _sides(n)
    keys = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = np.asarray(rows).astype(np.uint64)
    todo = np.arange(out.size)
    steps = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while todo.size:
        left, right = out[todo] // right_side, out[todo] % right_side
        for i in steps:
            if i % 2 == 0:
                add = _mixed(right ^ keys[i]) % left_side
                left = (left + (left_side - add if inverse else add)) % left_side
            else:
                add = _mixed(left ^ keys[i]) % right_side
                right = (right + (right_side - add if inverse else add)) % right_side
        out[todo] = left * right_side + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row number, without looking at any data."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The row number that sits at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def assign(numbered: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """`numbered` (with `row`, each number below `n` once) with shard int and slot long."""

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return (
        numbered.withColumn("_place", place("row"))
        .withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"_place div {shards}"))
        .drop("_place")
    )


def shard_documents(
    docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `rows`.

    Rows are numbered in the order of (doc_id, text_crc32, size), nulls first, so file layout
    has no part in the result; rows equal in all three are interchangeable. Row r goes to place
    permute(r): shard = place mod `shards`, slot = place div `shards`. Shard counts differ by one
    at most and slots have no gaps. `grown_shard` is null, as it belongs to another law. A null
    text has size 8 and checksum 0; an empty table gives no rows.
    """
    sized = texts_of(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    numbered, n = number_rows(sized, ["doc_id", "text_crc32", "size"], "shards")
    return assign(numbered, n, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
