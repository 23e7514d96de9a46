"""Lifetimes of names: chains of renames, renames logged twice, and positions that lie far apart."""

from __future__ import annotations

import pytest

from fleetlens.operators import replay
from fleetlens.plans.ordering import piece_width

KIND = "app_id string, pos long, kind string, table_name string, new_name string"


def log(spark, rows):
    return spark.createDataFrame([("a", *row) for row in rows], KIND)


def left(lifetimes):
    return sorted((r.table_name, r.first_name, r.first_pos) for r in replay.replay_tables(lifetimes).collect())


@pytest.mark.parametrize("width", [None, 1 << 20])
def test_long_chain_of_renames(spark, width):
    rows = [(10**9, "create_table", "t0", None)]
    rows += [((k + 2) * 10**9, "rename_table", f"t{k}", f"t{k + 1}") for k in range(40)]
    rows += [((k + 100) * 10**9, "rename_table", f"u{k}", f"u{k + 1}") for k in range(40)]
    assert left(replay.table_lifetimes(log(spark, rows), width)) == [("t40", "t0", 10**9)]


def test_refused_rename_keeps_the_name(spark):
    rows = [
        (1, "create_table", "a", None),
        (2, "rename_table", "gone", "a"),
        (3, "rename_table", "a", "b"),
        (4, "rename_table", "a", "c"),
        (5, "rename_table", "b", "d"),
        (6, "create_table", "b", None),
    ]
    assert left(replay.table_lifetimes(log(spark, rows))) == [("b", "b", 6), ("d", "a", 1)]


def test_operations_logged_twice_count_once(spark):
    rows = [
        (1, "create_table", "a", None),
        (2, "rename_table", "a", "b"),
        (3, "rename_table", "b", "c"),
        (4, "rename_table", "c", "d"),
    ]
    assert left(replay.table_lifetimes(log(spark, rows * 2))) == [("d", "a", 1)]


def test_replay_without_a_shuffle_for_each_far_position(spark):
    """Far-apart positions of a key are one piece, not one for each row."""
    far = spark.range(1000).selectExpr("id % 3 AS k", "id * 1000000000 AS seq")
    assert piece_width(far, ["k"], "seq") is None


def test_pieces_of_a_hot_key_are_bounded(spark):
    hot = spark.range(1000).selectExpr("IF(id % 10 = 0, id, -1) AS k", "IF(id < 900, id, id * 1000000) AS seq")
    width = piece_width(hot, ["k"], "seq", 50)
    assert hot.selectExpr("k", f"floor(seq / {width}) AS p").groupBy("k", "p").count().agg({"count": "max"}).first()[0] <= 50
