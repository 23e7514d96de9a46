"""Rewriting of nested parentheses from the inside out, however deep they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def inside_out(text: Column, step: Callable[[Column], Column]) -> Column:
    """`step` done as often as `text` has opening parentheses, and once more.

    A step settles the innermost pairs, so that many rounds reach any depth; a text has few.
    """
    opening = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    return F.aggregate(F.sequence(F.lit(0), opening), text, lambda so_far, _round: step(so_far))


def outer_pair_dropped(text: Column) -> Column:
    """`text` without its first and last character if they are parentheses of one pair."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    moves = F.transform(F.regexp_extract_all(inner, F.lit("[()]"), 0), lambda p: F.when(p == "(", 1).otherwise(-1))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    lowest = F.aggregate(
        moves,
        state,
        lambda s, move: F.struct(
            (s["depth"] + move).alias("depth"), F.least(s["least"], s["depth"] + move).alias("least")
        ),
        lambda s: s["least"],
    )
    return F.when(text.rlike(r"^\([\s\S]*\)$") & (lowest >= 0), inner).otherwise(text)
