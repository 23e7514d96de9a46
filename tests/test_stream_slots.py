"""Streams whose keys are many and small: what is kept by slot, and logs whose times repeat."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_stream_amplification import batch, clock, event, operation, run

import __spark_entry__ as entry
from fleetlens.sources.scratch import new_path


def test_state_of_many_small_pieces_is_few_rows(spark):
    rows = [e for n in range(60) for e in operation(f"n{n}", n, n, 9)]
    random.Random(7).shuffle(rows)
    got, state = run(spark, [rows[:300], rows[300:], [clock(1000)], [clock(2000)]], gap="200 SECONDS", delay="100 SECONDS", width=1, slots=4)
    assert got == batch(spark, rows, width=1)
    # Without slots it was a row and more for each of the 540 pieces.
    assert 0 < max(sum(s) for s in state) <= 4 * 8
    assert state[-1] == [0, 0]


def test_operations_of_a_slot_end_apart(spark):
    # Of each operation piece 0 closes early and comes back, and operations end one after the other.
    parts, rows = [[] for _ in range(5)], []
    for n in range(3):
        start = 60 * n
        own = [event(f"n{n}", 0, start, "p")] + [event(f"n{n}", 10 + i, start + 5 + 4 * i, "q", f"b{i}", 6) for i in range(30)]
        late = [event(f"n{n}", 1, start + 90, "c", "x")] + [event(f"n{n}", 2 + i, start + 91 + i, "c", f"x{i}") for i in range(5)]
        rows += own + late
    for row in rows:
        parts[min(4, (int(row[-1]) - 1_700_000_000) // 60)].append(row)
    parts += [[clock(800)], [clock(1200)]]
    got, state = run(spark, parts, gap="20 SECONDS", delay="1 SECONDS", width=10, slots=1)
    assert got == batch(spark, rows, width=10)
    assert state[-1] == [0, 0]


def test_a_log_whose_copies_repeat_the_times_is_whole(spark):
    folder = new_path(spark, "copied")
    copies = spark.range(900).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + (id % 150) * 600) AS ts", "id % 6 + 10 * (id div 150) AS user_id",
        "element_at(array('view', 'click', 'purchase'), CAST(1 + id % 5 % 3 AS INT)) AS event_type", "CAST(id AS DOUBLE) AS value",
        "concat('{\"k\": ', id % 7, '}') AS props",
    )
    copies.repartition(4).write.parquet(f"{folder}/events.parquet")
    queries = entry.queries()

    def found(name):
        return sorted(map(str, queries[name](spark, folder).select(*columns).collect()))

    columns = ["app_id", "node_id", "parent_query", "child_query", "repetitions", "classification"]
    rows = found("l03_stream_amplification")
    assert rows == found("c15_detect_amplification")
    assert {r.split("node_id='")[1].split("'")[0] for r in rows} >= {f"test_{10 * c}" for c in range(6)}


def test_steps_of_arriving_files_are_whole_batches(spark):
    from fleetlens.registry.streaming import _arriving

    rows = spark.range(0, 60_000, 1, 5).select(F.when(F.col("id") > 9, F.col("id")).alias("pos"))
    path, files = _arriving(rows, "pos", "steps", "json")
    steps = spark.read.schema("pos bigint").json(path).select("pos", F.input_file_name().alias("file"))
    spans = steps.groupBy("file").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("n")).collect()
    assert files >= 2 and len(spans) == 3 * files and sum(s.n for s in spans) == 60_000
    assert not any(s.low < edge <= s.high for s in spans for edge in (10 + 59_990 // 3, 10 + 2 * 59_990 // 3))
