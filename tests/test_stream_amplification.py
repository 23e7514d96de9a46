"""Amplification as a stream: state that goes when an operation is complete, the batch's rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.workload import OPERATION, detect_amplification
from fleetlens.sources.scratch import new_path
from fleetlens.streaming import sinks, workload

START = 1_700_000_000


def event(node, sequence, second, query, bind="b", rowcount=1, kind="read"):
    at = f"{START + second}"
    return ("app", "run", node, "call", sequence, 1, query, kind, rowcount, bind, at)


COLUMNS = "app_id string, run_id string, node_id string, phase string, sequence long, duration_us long, query_id string, statement_class string, rowcount long, bind string, second string"


def clock(second):
    return (None, None, None, None, None, None, None, None, None, None, f"{START + second}")


def run(spark, parts, **options):
    """(rows, state rows of both operators after each batch)."""
    path = new_path(spark, "amplification-events")
    for part in parts:
        frame = spark.createDataFrame(part, COLUMNS).withColumn("at", F.timestamp_seconds(F.col("second").cast("long"))).drop("second")
        frame.coalesce(1).write.mode("append").json(path)
    events = workload.event_stream(spark, path, 1)
    sinks.use_rocksdb(events)
    stream = workload.amplification(events, **options)
    out = new_path(spark, "amplification-out")
    query = sinks.start_append(stream, out, new_path(spark, "amplification-checkpoint"))
    query.awaitTermination()
    state = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in query.recentProgress]
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), state


def batch(spark, rows, width=3):
    frame = spark.createDataFrame(rows, COLUMNS).withColumn("bind_signature", F.array("bind"))
    found = detect_amplification(frame, width=width)
    return sorted(tuple(r) for r in found.select(*OPERATION, "parent_query", "child_query", "repetitions", "classification").collect())


def operation(node, second, seed, n=23):
    rnd = random.Random(seed)
    return [
        event(node, i, second + i, rnd.choice("pqr"), rnd.choice(["x", "y", None]), rnd.choice([5, 7, 8]), rnd.choice(["read", "write"]))
        for i in range(n)
    ]


def test_state_goes_and_rows_are_those_of_the_batch(spark):
    first, second = operation("n1", 0, 1), operation("n2", 100, 2)
    plain = [event("n3", i, 110 + i, "v") for i in range(3)]
    rnd = random.Random(4)
    both = second + plain
    rnd.shuffle(both)
    parts = [first[12:], first[:12], both[:9], both[9:], [clock(1000)], [clock(2000)]]
    got, state = run(spark, parts, gap="30 SECONDS", delay="20 SECONDS", width=3)
    assert got == batch(spark, first + second + plain)
    assert max(s[-1] + s[0] for s in state) > 0
    assert state[-1] == [0, 0]


def test_answers_come_before_the_end_of_the_log(spark):
    first, second = operation("n1", 0, 3), operation("n2", 200, 5)
    got, state = run(spark, [first, second[:10], second[10:]], gap="10 SECONDS", delay="5 SECONDS", width=4)
    assert got == batch(spark, first, width=4)
    assert any(state[-1])


def test_a_piece_that_idles_while_its_operation_goes_on(spark):
    # Piece 0 closes after its first event; the others keep the operation open until it is back.
    rows = [event("n", 0, 0, "p")] + [event("n", 10 + i, 5 + 4 * i, "q", f"b{i}", 6) for i in range(30)]
    late = [event("n", 1, 90, "c", "x")] + [event("n", 2 + i, 91 + i, "c", f"x{i}") for i in range(5)]
    parts = [rows[:8], rows[8:16], rows[16:24], rows[24:] + late, [clock(500)], [clock(900)]]
    got, state = run(spark, parts, gap="20 SECONDS", delay="1 SECONDS", width=10)
    assert got == batch(spark, rows + late, width=10)
    assert state[-1] == [0, 0]


@pytest.mark.parametrize("rows", [[], [clock(5)]])
def test_no_events(spark, rows):
    assert run(spark, [rows] if rows else [[clock(1)]], gap="1 SECONDS", delay="1 SECONDS")[0] == []
