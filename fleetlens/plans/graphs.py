"""Levels and cycles of many small directed graphs at once.

Edges are (keys, child, parent). Rounds are joins over written tables, driven by row counts, never
by collected rows, so memory does not depend on the size of one graph. Runs of nodes with one
parent are followed by jumps that triple in length; what is left after each contraction is a graph
of joints only. So rounds follow how deeply branches nest, and the logarithm of the longest run.
Cycles are contracted to one node each, whole ones at a time.

Both sides of a join grow with the fleet, and there are many joins, so they are sort-merge joins:
broadcasts, each within its limit, would bring the graph through the driver again with every round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize


def shuffled(side: DataFrame) -> DataFrame:
    """`side` of a join that is not to be broadcast."""
    return side.hint("merge")


def _follow(nodes: DataFrame, steps: DataFrame, keys: list[str], end: str, length: str) -> DataFrame:
    """Move `end` of each row of `nodes` along the step that starts there; `moved` tells which did."""
    step = steps.select(
        *keys, F.col("node").alias(end), F.col("anchor").alias("_next"), F.col("distance").alias("_more")
    )
    return (
        nodes.join(shuffled(step), [*keys, end], "left")
        .withColumn("moved", F.col("_more").isNotNull())
        .withColumn(end, F.when(F.col("moved"), F.col("_next")).otherwise(F.col(end)))
        .withColumn(length, F.col(length) + F.coalesce("_more", F.lit(0).cast("long")))
        .drop("_next", "_more")
    )


def _anchored(singles: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, node, anchor, distance) with every anchor outside of the nodes, where there is one.

    A node that runs into a cycle of such nodes keeps an anchor inside.
    """
    columns = [*keys, "node", "anchor", "distance"]
    reach = 1
    while True:
        once = _follow(singles, singles, keys, "anchor", "distance").drop("moved")
        twice = materialize(_follow(once, singles, keys, "anchor", "distance"), "anchors")
        singles, reach = twice.select(*columns), reach * 3
        if reach > size or twice.where("moved").isEmpty():
            return singles


def _longest(edges: DataFrame, keys: list[str]) -> DataFrame:
    """One edge for each (child, parent), the longest."""
    return edges.groupBy(*keys, "child", "parent").agg(F.max("length").alias("length"))


def peel(edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(levels, stuck): levels of every child that depends on no cycle, and the edges left.

    `levels` holds (keys, node, level) with level >= 1, the longest way from a node without
    parents; those are level 0 and not listed. `stuck` holds the edges between nodes on or behind
    a cycle. A parent of null stands for all nodes without parents.
    """
    keys = list(keys)
    whole = materialize(edges.select(*keys, "child", "parent").distinct(), "edges")
    inner = whole.select(*keys, F.col("child").alias("parent")).distinct().withColumn("_inner", F.lit(True))
    pending = materialize(
        _longest(
            whole.join(shuffled(inner), [*keys, "parent"], "left")
            .withColumn("parent", F.when(F.col("_inner"), F.col("parent")))
            .withColumn("length", F.lit(1).cast("long")),
            keys,
        ),
        "edges",
    )
    solved: list[DataFrame] = []
    while True:
        singles = materialize(
            pending.groupBy(*keys, F.col("child").alias("node"))
            .agg(F.count("*").alias("_n"), F.max("parent").alias("anchor"), F.max("length").alias("distance"))
            .where("_n = 1")
            .drop("_n"),
            "singles",
        )
        size = singles.count()
        if size == 0:
            break
        anchors = _anchored(singles, keys, size)
        solved.append(anchors)
        joints = pending.join(
            shuffled(anchors.select(*keys, F.col("node").alias("child"))), [*keys, "child"], "left_anti"
        )
        pending = materialize(
            _longest(_follow(joints, anchors, keys, "parent", "length"), keys), "edges"
        )
    known = whole.select(*keys, F.col("child").alias("node"), F.lit(0).cast("long").alias("level")).where("false")
    for anchors in reversed(solved):
        first = anchors.where("anchor IS NULL").select(*keys, "node", F.col("distance").alias("level"))
        bases = known.select(*keys, F.col("node").alias("anchor"), F.col("level").alias("_base"))
        later = anchors.join(shuffled(bases), [*keys, "anchor"]).select(
            *keys, "node", (F.col("_base") + F.col("distance")).alias("level")
        )
        known = materialize(known.unionByName(first).unionByName(later), "levels")
    levels = known.withColumn("level", F.col("level").cast("int"))
    open_nodes = (
        whole.select(*keys, F.col("child").alias("node"))
        .distinct()
        .join(shuffled(known.select(*keys, "node")), [*keys, "node"], "left_anti")
    )
    stuck = whole.join(shuffled(open_nodes.withColumnRenamed("node", "child")), [*keys, "child"], "left_semi").join(
        shuffled(open_nodes.withColumnRenamed("node", "parent")), [*keys, "parent"], "left_semi"
    )
    return levels, stuck.select(*keys, "child", "parent")


def _trim(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges between nodes that are behind a cycle (or on it) and also before one."""
    for _direction in range(2):
        _levels, stuck = peel(edges, keys)
        edges = stuck.select(*keys, F.col("parent").alias("child"), F.col("child").alias("parent"))
    return materialize(edges, "edges")


def _spread(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, up, down): greatest node that reaches each node, and that it reaches."""
    nodes = (
        edges.select(*keys, F.explode(F.array("child", "parent")).alias("node"))
        .distinct()
        .withColumn("up", F.col("node"))
        .withColumn("down", F.col("node"))
    )
    labels = materialize(nodes, "labels")
    own = F.struct("node", "up", "down")
    while True:
        child = labels.select(*keys, F.col("node").alias("child"), F.col("down").alias("child_down"))
        parent = labels.select(*keys, F.col("node").alias("parent"), F.col("up").alias("parent_up"))
        # A child is reached from what reaches its parent; a parent reaches what its child reaches.
        passed = F.array(
            F.struct(F.col("child").alias("node"), F.col("parent_up").alias("up"), F.col("child").alias("down")),
            F.struct(F.col("parent").alias("node"), F.col("parent").alias("up"), F.col("child_down").alias("down")),
        )
        news = (
            edges.join(shuffled(child), [*keys, "child"])
            .join(shuffled(parent), [*keys, "parent"])
            .select(*keys, F.inline(passed))
            .withColumn("old", F.lit(None).cast(labels.select(own.alias("o")).schema["o"].dataType))
        )
        spread = materialize(
            news.unionByName(labels.withColumn("old", own))
            .groupBy(*keys, "node")
            .agg(F.max("up").alias("up"), F.max("down").alias("down"), F.max("old").alias("old"))
            .withColumn("moved", (F.col("up") != F.col("old.up")) | (F.col("down") != F.col("old.down")))
            .drop("old"),
            "labels",
        )
        labels = spread.drop("moved")
        if spread.where("moved").isEmpty():
            return labels


def _picked_cycles(edges: DataFrame, keys: list[str], turn: int, size: int) -> DataFrame:
    """(keys, node, best): nodes on cycles of the graph in which each child keeps one parent.

    Every walk along picked parents ends or runs into such a cycle. After `size` steps all that
    still walk stand on one, and have seen its greatest node; jumps triple in length.
    """
    chosen = F.max_by("parent", F.struct(F.xxhash64(F.lit(turn), "parent", "child"), "parent"))
    walks = edges.groupBy(*keys, F.col("child").alias("node")).agg(chosen.alias("at")).withColumn("best", F.col("at"))

    def further(rows: DataFrame, steps: DataFrame) -> DataFrame:
        step = steps.select(*keys, F.col("node").alias("at"), F.col("at").alias("_next"), F.col("best").alias("_best"))
        return rows.join(shuffled(step), [*keys, "at"]).select(
            *keys, "node", F.col("_next").alias("at"), F.greatest("best", "_best").alias("best")
        )

    walks, reach = materialize(walks, "walks"), 1
    while reach < size and not walks.isEmpty():
        walks, reach = materialize(further(further(walks, walks), walks), "walks"), reach * 3
    on_cycle = walks.select(*keys, F.col("at").alias("node")).distinct()
    return materialize(walks.join(shuffled(on_cycle), [*keys, "node"], "left_semi").select(*keys, "node", "best"), "cycles")


def _renamed(rows: DataFrame, names: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`rows` with the values of `column` replaced that `names` (keys, node, best) has."""
    name = names.select(*keys, F.col("node").alias(column), F.col("best").alias("_best"))
    return (
        rows.join(shuffled(name), [*keys, column], "left")
        .withColumn(column, F.coalesce("_best", column))
        .drop("_best")
    )


def _solved(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, best): components that forward and backward labels of greatest nodes settle."""
    return materialize(_spread(edges, keys).where("up = down").select(*keys, "node", F.col("up").alias("best")), "solved")


def cycle_members(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, component): every node on a cycle, with the greatest node of its component.

    `node` ids are text. Each round every node keeps one of its parents, or in the next round one of
    its children; the cycles of what is kept are cycles of the graph and become one node each. So a
    cycle of any length goes in the logarithm of its length. Where that takes away few nodes, what
    lies before or behind all cycles is trimmed off; and where that too does little, every node being
    on many short ways, labels spread hop by hop.
    """
    keys = list(keys)
    whole = materialize(edges.select(*keys, "child", "parent").distinct(), "edges")
    loops = whole.where("child = parent").select(*keys, F.col("child").alias("node"), F.col("child").alias("component"))
    open_edges = whole.where("child <> parent")
    members = loops.where(F.lit(False))
    turn = 0
    while True:
        nodes = open_edges.select(*keys, F.explode(F.array("child", "parent")).alias("node")).distinct()
        sizes = nodes.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
        if not sizes.n:
            break
        names = _picked_cycles(open_edges, keys, turn, sizes.most)
        groups = names.select(*keys, "best").distinct()
        if 8 * (names.count() - groups.count()) < sizes.n:
            open_edges = _trim(open_edges, keys)
            left = open_edges.select(*keys, "child").distinct().count()
            # The cycles that were found are found again, unless too little goes.
            if 8 * (sizes.n - left) >= sizes.n:
                continue
            names = _solved(open_edges, keys)
            gone = names.select(*keys, "node")
            for end in ("child", "parent"):
                open_edges = open_edges.join(shuffled(gone.withColumnRenamed("node", end)), [*keys, end], "left_anti")
        sizable = names.groupBy(*keys, "best").agg(F.count("*").alias("_n")).where("_n > 1")
        joined = names.join(shuffled(sizable), [*keys, "best"])
        found = joined.select(*keys, "node", F.col("best").alias("component"))
        known = _renamed(members, names, keys, "component")
        members = materialize(
            known.unionByName(found.join(shuffled(members.select(*keys, "node")), [*keys, "node"], "left_anti")), "members"
        )
        open_edges = materialize(
            _renamed(_renamed(open_edges, names, keys, "child"), names, keys, "parent")
            .where("child <> parent")
            .select(*keys, F.col("parent").alias("child"), F.col("child").alias("parent"))
            .distinct(),
            "edges",
        )
        turn += 1
    return members.unionByName(loops).groupBy(*keys, "node").agg(F.max("component").alias("component"))
