"""Measurement documents in files of many."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fleetlens.registry.inputs import frame
from fleetlens.registry.measure import bench_documents
from fleetlens.sources import bench_runs
from fleetlens.sources.scratch import new_path


def document(run, **fields):
    arms = {"control_a1": {"warmups": [1], "samples": [run or 0, 2], "rows": 3}}
    return json.dumps({"case_id": "c\u001e", "run": run, "arms": arms} | fields, indent=1)


def test_documents_of_many_lines_come_back(spark):
    path = new_path(spark, "bench-sequences")
    texts = [document(n) for n in range(50)] + ['{"case_id": "x",\n "run', document(None)]
    bench_runs.write_bench_sequences(spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1), path)
    runs, problems = bench_runs.read_bench_runs(spark, path, sequences=True)
    assert sorted((r.case_id, r.run) for r in runs.collect()) == [("c\u001e", n) for n in range(50)]
    assert sorted(r.problem for r in problems.collect()) == ["missing required field 'run'", "unreadable or malformed JSON"]
    assert len(runs.inputFiles()) == 1


def test_the_query_writes_fewer_files_than_documents(spark, sf_dir):
    from __spark_entry__ import queries

    rows = queries()["b01_read_bench_runs"](spark, sf_dir)
    documents = bench_documents(spark, sf_dir).count()
    assert len(rows.inputFiles()) < documents / 2
    assert rows.where("kind = 'sample'").count() <= frame(spark, sf_dir, "events").count()
