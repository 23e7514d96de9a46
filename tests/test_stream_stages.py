"""State of stage logs as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import quality
from fleetlens.sources.scratch import new_path
from fleetlens.streaming import sinks, stages


def test_stages_of_a_run_share_a_state_row(spark):
    path = new_path(spark, "stages")
    for low in (0, 500):
        rows = spark.range(low, low + 500, 1, 1).selectExpr(
            "concat('r', id % 10) AS run_id", "concat('\"s\\\\', id % 40) AS stage", "IF(id % 3 = 0, 'running', 'complete') AS status",
            "id AS pos", "IF(id % 7 > 0, concat('t', id), NULL) AS at",
        )
        rows.write.mode("append").json(path)
    events = stages.stage_stream(spark, path, 1)
    sinks.use_rocksdb(events)
    out = new_path(spark, "moves")
    query = sinks.start_append(stages.stage_moves(events), out, new_path(spark, "moves-checkpoint"))
    query.awaitTermination()
    # It was a row for each of the 40 stages.
    assert [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]] == [10]
    found = spark.read.parquet(out)
    log = spark.read.schema(stages.STAGE_SCHEMA).json(path)
    expected = quality.stage_transitions(log, width=64)
    columns = ["run_id", "stage", "pos", "previous", "status", "legal"]
    assert found.where("NOT late").count() == 1000
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))
    first = {r[0]: r[1] for r in log.where("at IS NOT NULL").groupBy("stage").agg(F.min_by("at", "pos")).collect()}
    assert all(r.started_at == first[r.stage] for r in found.where("pos > 900").collect())
