"""Rounds over graphs bring no table through the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.plans import graphs


def test_rounds_join_without_broadcasts(spark):
    steps = spark.createDataFrame([("a", f"n{i}", f"n{i + 1}", 1) for i in range(9)], "app_id string, node string, anchor string, distance long")
    names = steps.select("app_id", "node", F.col("anchor").alias("best"))
    followed = graphs._follow(steps, steps, ["app_id"], "anchor", "distance")
    renamed = graphs._renamed(steps, names, ["app_id"], "anchor")
    for joined in (followed, renamed):
        rows = {(r.node, r.anchor) for r in joined.collect()}
        assert rows == {(f"n{i}", f"n{min(i + 2, 9)}") for i in range(9)}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
