"""Streams over files that do not come in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.sources.scratch import new_path
from fleetlens.streaming import load, sinks, stages


def _files(spark, parts, schema, form):
    """One file for each part, of rising modification time."""
    path = new_path(spark, "arriving")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").format(form).save(path)
    return path


def test_a_late_stage_row_is_marked_and_changes_nothing(spark):
    parts = [
        [("r", "s", "running", 1, "t1", None), ("r", "s", "complete", 3, "t3", None), ("r", "z", "complete", 1, "t1", None)],
        [("r", "s", "cancelled", 2, "t2", None)],
        [("r", "s", "running", 4, "t4", None)],
    ]
    events = stages.stage_stream(spark, _files(spark, parts, stages.STAGE_SCHEMA, "json"), 1)
    sinks.use_rocksdb(events)
    rows = sinks.drain(stages.stage_moves(events), "late-stages").collect()
    assert {(r.stage, r.pos): (r.previous, r.legal, r.started_at, r.late) for r in rows} == {
        ("s", 1): ("pending", True, "t1", False),
        ("s", 3): ("running", True, "t1", False),
        ("s", 2): (None, None, None, True),
        ("s", 4): ("complete", False, "t1", False),
        ("z", 1): ("pending", False, "t1", False),
    }


def test_rows_behind_the_watermark_stay_out_of_a_window(spark):
    def part(*rows: tuple[str, float]):
        return [(f"2024-01-01 {at}", "a", value) for at, value in rows]

    parts = [
        part(("00:10:00", 1.0), ("05:00:00", 1.0)),
        part(("05:10:00", 1.0)),
        # The watermark of 04:00 that the first file sets cuts from the batch after the next: it
        # lets 04:30 in and keeps 00:20 out.
        part(("00:20:00", 100.0), ("04:30:00", 2.0)),
        part(("12:00:00", 1.0)),
        part(("12:10:00", 1.0)),
    ]
    path = _files(spark, parts, "ts string, event_type string, value double", "json")
    events = (
        spark.readStream.schema("ts string, event_type string, value double")
        .option("maxFilesPerTrigger", 1)
        .json(path)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    rows = sinks.drain(load.windowed_load(events, "1 hour"), "late-load").collect()
    got = {(r.starts.hour, r.events, r.load) for r in rows}
    assert {(h, n, v) for h, n, v in got if h < 10} == {(0, 1, 1.0), (4, 1, 2.0), (5, 2, 2.0)}
