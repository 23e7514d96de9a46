"""Checks that stand together in one partition are recognized by all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators.generate import recognize_checks
from fleetlens.plans.partitions import dealt


def test_checks_of_one_partition_are_dealt_out(spark):
    rows = spark.range(4000).repartition(8, "id").withColumn("_at", F.spark_partition_id()).where("_at = 3")
    counts = [r["count"] for r in dealt(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == rows.count()
    assert len(counts) >= 8 and max(counts) < 2 * min(counts)


def test_a_check_is_worked_out_in_stages(spark):
    """Each stage is a projection of its own, so no text is worked out once for each mention."""
    checks = spark.range(5).select(F.concat(F.lit("((n >= "), F.col("id"), F.lit("))")).alias("expression"))
    plan = recognize_checks(checks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("::(?:character varying") == 1
