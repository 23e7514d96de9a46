"""Cycles of many graphs: members, components and the number of rounds."""

from __future__ import annotations

import random

from fleetlens.plans import graphs


def brute(edges):
    """{node: greatest node of its component} of every node on a cycle, by reachability."""
    after = {}
    for child, parent in edges:
        after.setdefault(parent, set()).add(child)
    reach = {}
    for start in after:
        seen, todo = set(), [start]
        while todo:
            for child in after.get(todo.pop(), ()):
                if child not in seen:
                    seen.add(child)
                    todo.append(child)
        reach[start] = seen
    on = {n for n, seen in reach.items() if n in seen}
    return {n: max(m for m in on if m in reach[n] and n in reach[m]) for n in on}


def members(spark, graphs_of):
    rows = [(app, child, parent, "x") for app, edges in graphs_of.items() for child, parent in edges]
    edges = spark.createDataFrame(rows, "app string, child string, parent string, node string")
    found = graphs.cycle_members(edges, ["app"]).collect()
    out = {(r.app, r.node): r.component for r in found}
    assert len(out) == len(found)
    return out


def wanted(graphs_of):
    return {(app, n): c for app, edges in graphs_of.items() for n, c in brute(edges).items()}


def test_tangles_beside_reachability(spark):
    rnd = random.Random(11)
    graphs_of = {}
    for k in range(16):
        size = rnd.choice([3, 8, 12])
        graphs_of[f"t{k}"] = [(f"n{rnd.randrange(size)}", f"n{rnd.randrange(size)}") for _ in range(rnd.randrange(1, 3 * size))]
    graphs_of["two rings and a bridge"] = [(f"a{i}", f"a{(i + 1) % 9}") for i in range(9)] + [("b0", "a3"), ("b0", "b1"), ("b1", "b2"), ("b2", "b0")]
    graphs_of["eight"] = [(f"a{i}", f"a{(i + 1) % 5}") for i in range(5)] + [("a0", "z1"), ("z1", "z2"), ("z2", "a0"), ("z2", "t")]
    graphs_of["none"] = [(f"n{i + 1}", f"n{i}") for i in range(40)]
    assert members(spark, graphs_of) == wanted(graphs_of)


def counted(monkeypatch):
    calls, plain = [], graphs.materialize

    def count(df, label):
        calls.append(label)
        return plain(df, label)

    monkeypatch.setattr(graphs, "materialize", count)
    return calls


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    calls = counted(monkeypatch)
    names = [f"n{i:04}" for i in range(5000)]
    got = members(spark, {"ring": list(zip(names, names[1:] + names[:1]))})
    assert got == {("ring", n): "n4999" for n in names}
    assert len(calls) <= 40


def test_shapes_that_contract_slowly(spark, monkeypatch):
    calls = counted(monkeypatch)
    rnd = random.Random(3)
    n = 48
    ring = [(f"n{(i + 1) % n:03}", f"n{i:03}") for i in range(n)]
    graphs_of = {
        "both ways": [e for i in range(n - 1) for e in ((f"n{i:03}", f"n{i + 1:03}"), (f"n{i + 1:03}", f"n{i:03}"))],
        "ladder": ring + [(f"n{(i + 2) % n:03}", f"n{i:03}") for i in range(n)],
        "chords": ring + [(f"n{rnd.randrange(n):03}", f"n{rnd.randrange(n):03}") for _ in range(12)],
        "chain of rings": [e for r in range(5) for e in [(f"r{r:02}{(i + 1) % 5}", f"r{r:02}{i}") for i in range(5)] + [(f"r{r + 1:02}0", f"r{r:02}2")]],
    }
    assert members(spark, graphs_of) == wanted(graphs_of)
    assert len(calls) <= 250
