"""Fingerprints and shapes of plan trees of several forms, among them a very deep one."""

from __future__ import annotations

import hashlib
import json
import random

from fleetlens.operators import plan_trees


def node(kind, *below, **fields):
    return {"Node Type": kind, **{k.replace("_", " "): v for k, v in fields.items()}, "Plans": list(below)}


def test_shapes_and_fingerprints(spark):
    scan = node("Seq Scan", Relation_Name="t")
    deep = node("Seq Scan", Relation_Name="leaf")
    for _ in range(1500):
        deep = node("Limit", deep)
    trees = [
        scan,
        node("Append", scan, node("Index Scan", Index_Name="ix", Relation_Name="t"), node("Result")),
        node("Hash Join", scan, node("Hash", node("Sort", scan, Sort_Key=["a", "é"])), Join_Type="Inner"),
        node("Hash Join", node("Hash", node("Sort", scan, Sort_Key=["a", "é"])), scan, Join_Type="Inner"),
        deep,
    ]
    docs = [json.dumps([{"Plan": t}]) for t in trees] + ["{", None, "[]"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    shapes = {r.k: r.normalized_shape for r in plan_trees.plan_shapes(df, ["k"]).collect()}
    assert shapes[0] == "Seq Scan on t"
    assert shapes[1] == "Append -> (Seq Scan on t, Index Scan using ix, Result)"
    assert shapes[2] == "Inner Hash Join -> (Seq Scan on t, Hash -> (Sort -> (Seq Scan on t)))"
    assert shapes[4] == "Limit -> (" * 1500 + "Seq Scan on leaf" + ")" * 1500
    assert [shapes[k] for k in (5, 6, 7)] == [None] * 3
    prints = {r.k: r.plan_fingerprint for r in plan_trees.plan_fingerprints(df, ["k"]).collect()}
    assert len({prints[k] for k in range(5)}) == 5
    assert [prints[k] for k in (5, 6, 7)] == [None] * 3


def test_rows_of_shallow_and_deep_plans_agree(spark):
    rnd = random.Random(6)

    def tree(depth):
        below = [tree(depth - 1) for _ in range(rnd.choice([0, 1, 2, 3]) if depth else 0)]
        fields = {"Relation_Name": rnd.choice([None, "t\"é\n"]), "Plan_Rows": rnd.randrange(9), "Sort_Key": rnd.choice([[], None, ["a", "b"]])}
        return node(rnd.choice("ABC"), *below, **fields, **rnd.choice([{}, {"Shared_Hit_Blocks": 3}, {"WAL_Bytes": 5}]))

    def under(plan, times):
        for _ in range(times):
            plan = node("Limit", plan)
        return plan

    plans = [tree(rnd.randrange(6)) for _ in range(20)]
    docs = [(f"{k}-{times}", json.dumps([{"Plan": under(p, times)}])) for k, p in enumerate(plans) for times in (0, plan_trees.LEVELS + 1)]
    df = spark.createDataFrame(docs, "k string, doc string")
    found = {}
    for r in plan_trees.flatten_plans(df, ["k"]).collect():
        found.setdefault(r.k, []).append(r.asDict())
    more = plan_trees.LEVELS + 1
    for k in range(20):
        shallow, deep = (sorted(found[f"{k}-{times}"], key=lambda r: r["node"]) for times in (0, more))
        assert [r["node"] for r in deep] == list(range(len(shallow) + more))
        moved = [{**r, "k": r["k"].replace(f"-{more}", "-0"), "node": r["node"] - more, "depth": r["depth"] - more} for r in deep[more:]]
        for r in moved:
            r["parent"] = None if r["node"] == 0 else r["parent"] - more
        assert moved == shallow
    shapes = {r.k: r.normalized_shape for r in plan_trees.plan_shapes(df, ["k"]).collect()}
    prints = {r.k: r.plan_fingerprint for r in plan_trees.plan_fingerprints(df, ["k"]).collect()}
    for k, plan in enumerate(plans):
        assert shapes[f"{k}-{more}"] == "Limit -> (" * more + shapes[f"{k}-0"] + ")" * more
        for times in (0, more):
            assert prints[f"{k}-{times}"] == "sha256:" + hashlib.sha256(canonical(under(plan, times)).encode()).hexdigest()


def canonical(plan):
    fields = {"group_key": "Group Key", "index_name": "Index Name", "join_type": "Join Type", "node_type": "Node Type", "relation_name": "Relation Name", "scan_direction": "Scan Direction", "sort_key": "Sort Key", "strategy": "Strategy"}
    own = [f'"{n}":' + json.dumps((plan.get(f) or []) if n.endswith("_key") else plan.get(f), separators=(",", ":"), ensure_ascii=False) for n, f in fields.items()]
    return '{"children":[' + ",".join(map(canonical, plan["Plans"])) + "]," + ",".join(own) + "}"


def test_no_python_where_every_plan_parses(spark, monkeypatch):
    plans = []
    plain = plan_trees.materialize

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(plan_trees, "materialize", seen)
    plan = json.dumps([{"Plan": node("Result")}])
    df = spark.range(0, 10, 1, spark.sparkContext.defaultParallelism).selectExpr("id AS k", f"concat('{plan}', '') AS doc")
    answer = plan_trees.plan_fingerprints(df, ["k"])
    plans.append(answer._jdf.queryExecution().executedPlan().toString())
    assert not any("Arrow" in p or "Python" in p or "Exchange" in p for p in plans)


def test_a_document_is_not_copied_for_each_level(spark, monkeypatch):
    folds = []
    plain = plan_trees.materialize

    def seen(df, label):
        folds.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(plan_trees, "materialize", seen)
    df = spark.createDataFrame([(1, json.dumps([{"Plan": node("Limit", node("Result"))}]))], "k int, doc string")
    for operator in (plan_trees.plan_fingerprints, plan_trees.plan_shapes, plan_trees.flatten_plans):
        operator(df, ["k"])
    assert [f.count("Project [") <= 4 for f in folds] == [True] * 3


def test_places_of_plans_of_odd_forms(spark):
    wide = node("Append", *(node("Sort", node("Seq Scan", Relation_Name=f"t{i}")) for i in range(40)))
    odd = {"Node Type": "Limit", "Plan Rows": "7", "WAL Records": None, "Plans": {"Node Type": "Result"}}
    bare = {"Node Type": "Result", "Plan Rows": 2.5, "WAL Bytes": 3}
    docs = [(k, json.dumps([{"Plan": p}])) for k, p in enumerate([wide, odd, bare])]
    rows = {}
    for r in plan_trees.flatten_plans(spark.createDataFrame(docs, "k int, doc string"), ["k"]).collect():
        rows.setdefault(r.k, []).append(r)
    found = sorted(rows[0], key=lambda r: r.node)
    assert [(r.node, r.parent, r.depth) for r in found[:5]] == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, 0, 1), (4, 3, 2)]
    assert [r.relation_name for r in found[2::2]] == [f"t{i}" for i in range(40)]
    assert [(r.plan_rows, r.wal_records, r.sort_key) for r in rows[1]] == [(7.0, None, "[]")]
    assert [(r.plan_rows, r.wal_records, r.wal_bytes) for r in rows[2]] == [(2.5, 0, 3)]
