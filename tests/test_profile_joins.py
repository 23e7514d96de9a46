"""Probes take the few rows of a column to its values, never all values of a column to one task."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import profile
from fleetlens.operators.profile import Predicate


@pytest.fixture
def no_automatic_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_counts_do_not_gather_a_column(spark, no_automatic_broadcast):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(start + timedelta(days=d),) for d in range(50)] + [(None,)], "at timestamp")
    wanted = [Predicate("t", "at", 1, ">", "timestamp_range"), Predicate("t", "at", 2, "<=", "timestamp_range")]
    probes = profile.timestamp_window_probes(rows, wanted)
    assert {(r.operator, r.method): r.row_count for r in probes.collect()} == {
        (">", "recent_window"): 7, (">", "monthly_window"): 30, (">", "full_window"): 49,
        ("<=", "recent_window"): 8, ("<=", "monthly_window"): 31, ("<=", "full_window"): 50,
    }
    assert "BroadcastHashJoin" in physical(probes)


def test_ranks_and_medians_do_not_gather_a_column(spark, no_automatic_broadcast):
    numbers = spark.createDataFrame([(float(i % 20),) for i in range(100)], "x double")
    freq = profile.frequencies(numbers, ["x"], "double")
    assert "BroadcastHashJoin" in physical(profile.ranked_cutoffs(freq))
    assert "BroadcastHashJoin" in physical(profile.equality_probes(freq))
    found = profile.equality_probes(freq.withColumn("value", F.col("value").cast("string")))
    assert found.where("row_count = 5").count() == 3
