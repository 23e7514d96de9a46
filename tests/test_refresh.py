"""Stored rule results that follow their inputs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from fleetlens.operators import refresh
from fleetlens.operators.rules import Rule, RuleOutput
from fleetlens.sources.scratch import new_path


def rule(version=1, seen=None):
    def evaluate(ctx):
        if seen is not None:
            seen.append(ctx["rows"]._jdf.queryExecution())
        found = ctx["rows"].where("n > 5").select("app_id", F.concat(F.lit("F-"), "n").alias("id"))
        return RuleOutput(findings=found, questions=ctx["other"].select("app_id", F.col("m").alias("question")))

    return Rule("test.many", version, evaluate)


def frames(spark, rows):
    df = spark.createDataFrame(rows, "app_id string, n int, tags map<string,int>")
    other = spark.createDataFrame([("a1", "x"), ("a2", None), (None, "z")], "app_id string, m string")
    return {"rows": df, "other": other}


def shown(spark, store):
    out = refresh.stored_output(spark, store)
    return {tuple(r) for r in out.findings.select("app_id", "id").collect()}, sorted(
        (r.app_id, str(r.question)) for r in out.questions.collect()
    )


def test_only_changed_applications_are_made_anew(spark):
    store = new_path(spark, "rules")
    rows = [(f"a{i}", n, {"k": n}) for i in range(20) for n in (i, i + 1)] + [("007", 9, None)]

    def step(rows, rules):
        changed = {r.app_id: r.digest for r in refresh.refresh(frames(spark, rows), store, rules).collect()}
        findings, questions = shown(spark, store)
        assert findings == {(a, f"F-{n}") for a, n, _ in rows if n > 5}
        assert questions == [("a1", "x"), ("a2", "None")]
        return changed

    assert len(step(rows, [rule()])) == 21
    assert step(list(reversed(rows)), [rule()]) == {}
    moved = [("a7", 3, None) if r[0] == "a7" else r for r in rows if r[0] != "a9"]
    changed = step(moved, [rule()])
    assert set(changed) == {"a7", "a9"} and changed["a9"] is None
    assert set(step([*moved, ("a9", 1, None)], [rule()])) == {"a9"}
    assert len(step([*moved, ("a9", 1, None)], [rule(version=2)])) == 21


def test_the_scan_reads_the_changed_partition_alone(spark):
    path, store = new_path(spark, "partitioned"), new_path(spark, "rules")
    rows = spark.createDataFrame([(f"a{i}", n) for i in range(30) for n in range(12)], "app_id string, n int")
    rows.write.partitionBy("app_id").parquet(path)
    other = spark.createDataFrame([("a1", "x")], "app_id string, m string")

    def ctx():
        return {"rows": spark.read.parquet(path), "other": other}

    refresh.refresh(ctx(), store, [rule()])
    spark.createDataFrame([("a4", 77)], "app_id string, n int").write.mode("append").partitionBy("app_id").parquet(path)
    seen = []
    changed = refresh.refresh(ctx(), store, [rule(seen=seen)]).collect()
    assert [r.app_id for r in changed] == ["a4"]
    assert "dynamicpruning" in seen[0].executedPlan().toString()
    assert ("a4", "F-77") in shown(spark, store)[0]


def test_many_applications_share_folders(spark):
    store = new_path(spark, "rules")
    rows = [(f"a{i}", 9, None) for i in range(300)]
    refresh.refresh(frames(spark, rows), store, [rule()])
    moved = [("a5", 11, None), *rows[6:], ("b1", 8, None), ("b2", 1, None)]
    changed = refresh.refresh(frames(spark, moved), store, [rule()]).collect()
    # The other frame has rows of a1 and a2, which therefore stay.
    assert {r.app_id for r in changed} == {f"a{i}" for i in range(6)} | {"b1", "b2"}
    findings, questions = shown(spark, store)
    assert findings == {(a, f"F-{n}") for a, n, _ in moved if n > 5}
    assert questions == [("a1", "x"), ("a2", "None")]
    assert refresh.refresh(frames(spark, moved), store, [rule()]).isEmpty()
    for part in ("findings", "questions", "digests"):
        assert len([p for p in Path(store, part).iterdir() if p.is_dir()]) <= 64


def test_digests_count_copies_and_write_nothing(spark):
    folder = Path(new_path(spark, "none")).parent

    def digests(rows):
        return {r.app_id: r.digest for r in refresh.app_digests(frames(spark, rows), [rule()]).collect()}

    before = set(folder.iterdir())
    one = digests([("a1", 1, {"k": 1}), ("a1", 2, None), ("a2", 1, {"k": 1})])
    assert one == digests([("a2", 1, {"k": 1}), ("a1", 2, None), ("a1", 1, {"k": 1})])
    # A value moved to another row, a copy more, two copies more, a null for a value.
    for other in (
        [("a1", 1, None), ("a1", 2, {"k": 1})],
        [("a1", 1, {"k": 1}), ("a1", 2, None), ("a1", 2, None)],
        [("a1", 1, {"k": 1})] * 3 + [("a1", 2, None)],
        [("a1", 1, {"k": 1}), ("a1", None, None)],
    ):
        changed = digests([*other, ("a2", 1, {"k": 1})])
        assert changed["a1"] != one["a1"] and changed["a2"] == one["a2"]
    assert set(folder.iterdir()) == before
