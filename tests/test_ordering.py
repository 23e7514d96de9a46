"""Piecewise ordered work equals a plain window, whatever the piece size."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.plans import graphs
from fleetlens.plans.ordering import (
    carry_forward,
    position_by_sequence,
    previous_row,
    running_total,
)


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most of the rows."""
    return spark.range(500).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 3).otherwise(7).alias("k"),
        (F.col("id") * 3).alias("seq"),
        F.col("id").alias("v"),
    )


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_previous_row(rows, width):
    got = previous_row(rows, ["k"], "seq", ["v"], "p", width).select("k", "seq", "p.v")
    window = Window.partitionBy("k").orderBy("seq")
    want = rows.withColumn("p", F.lag("v").over(window)).select("k", "seq", F.col("p").alias("v"))
    assert same(got, want)


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_positions(rows, width):
    got = position_by_sequence(rows, ["k"], "seq", "n", width).select("k", "seq", "n")
    window = Window.partitionBy("k").orderBy("seq")
    want = rows.withColumn("n", F.row_number().over(window).cast("long")).select("k", "seq", "n")
    assert same(got, want)


@pytest.mark.parametrize("width", [1, 16, 10_000])
def test_carry_forward_skips_nulls(rows, width):
    value = F.when(F.col("v") % 7 == 0, F.col("v"))
    got = carry_forward(rows, ["k"], "seq", value, "c", width).select("k", "seq", "c")
    window = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("c", F.last(value, ignorenulls=True).over(window)).select("k", "seq", "c")
    assert same(got, want)


def test_running_total(rows):
    got = running_total(rows, ["k"], ["seq"], "t", weight=F.col("v")).select("k", "seq", "t")
    window = Window.partitionBy("k").orderBy("seq")
    want = rows.withColumn("t", F.sum("v").over(window)).select("k", "seq", "t")
    assert same(got, want)


def test_running_total_without_keys(rows):
    got = running_total(rows, [], ["seq"], "t").select("seq", "t")
    assert [r.t for r in got.orderBy("seq").collect()] == list(range(1, 501))


def test_levels_and_cycles(spark):
    edges = spark.createDataFrame(
        [
            ("a", "b", "a"), ("a", "c", "b"), ("a", "c", "a"),
            ("x", "p", "q"), ("x", "q", "p"), ("x", "r", "q"), ("x", "s", "r"),
            ("x", "t", "s"), ("x", "u", "t"), ("x", "t", "u"), ("y", "z", "z"),
        ],
        "app string, child string, parent string",
    )
    levels, stuck = graphs.peel(edges, ["app"])
    assert {tuple(r) for r in levels.collect()} == {("a", "b", 1), ("a", "c", 2)}
    assert {r.app for r in stuck.collect()} == {"x", "y"}
    members = {tuple(r) for r in graphs.cycle_members(edges, ["app"]).collect()}
    assert members == {
        ("x", "p", "q"), ("x", "q", "q"), ("x", "t", "u"), ("x", "u", "u"), ("y", "z", "z"),
    }


def _levels_by_walk(edges):
    """(levels, stuck) of one graph, level by level."""
    level, pending, at = {}, set(edges), 0
    while pending:
        at += 1
        waiting = {child for child, _ in pending}
        rest = {edge for edge in pending if edge[1] in waiting}
        if rest == pending:
            break
        level |= {child: at for child in waiting - {c for c, _ in rest}}
        pending = rest
    return level, pending


def test_levels_of_long_and_tangled_graphs(spark):
    import random

    chance = random.Random(5)
    graphs_of = {"chain": [(f"n{i + 1}", f"n{i}") for i in range(2000)]}
    diamonds = []
    for i in range(60):
        diamonds += [(f"a{i}", f"j{i}"), (f"b{i}", f"a{i}"), (f"c{i}", f"j{i}"), (f"j{i + 1}", f"b{i}"), (f"j{i + 1}", f"c{i}")]
    graphs_of["diamonds"] = diamonds
    graphs_of["loop behind a chain"] = [(f"n{i + 1}", f"n{i}") for i in range(30)] + [("n30", "n33"), ("n33", "n31"), ("n31", "n30"), ("z", "n5")]
    graphs_of["self"] = [("a", "a"), ("b", "a"), ("c", "b"), ("c", "d")]
    for k in range(8):
        size = 12
        graphs_of[f"tangle{k}"] = [(f"n{chance.randrange(size)}", f"n{chance.randrange(size)}") for _ in range(6 + 2 * k)]
        pairs = (sorted(chance.sample(range(size), 2)) for _ in range(25))
        graphs_of[f"order{k}"] = [(f"n{high}", f"n{low}") for low, high in pairs]
    rows = [(app, child, parent) for app, edges in graphs_of.items() for child, parent in edges]
    edges = spark.createDataFrame(rows, "app string, child string, parent string")
    levels, stuck = graphs.peel(edges, ["app"])
    got_levels = {(r.app, r.node): r.level for r in levels.collect()}
    got_stuck = {(r.app, r.child, r.parent) for r in stuck.collect()}
    want = {app: _levels_by_walk(pairs) for app, pairs in graphs_of.items()}
    assert got_levels == {(app, node): at for app, (level, _) in want.items() for node, at in level.items()}
    assert got_stuck == {(app, *edge) for app, (_, left) in want.items() for edge in left}


def test_levels_of_no_edges(spark):
    edges = spark.createDataFrame([], "app string, child string, parent string")
    levels, stuck = graphs.peel(edges, ["app"])
    assert levels.count() == 0 and stuck.count() == 0
    assert graphs.cycle_members(edges, ["app"]).count() == 0
