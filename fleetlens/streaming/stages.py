"""Stage logs and capture lines as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetlens.operators.quality import STAGE_MOVES
from fleetlens.sources.capture import parse_capture_lines

STAGE_SCHEMA = "run_id string, stage string, status string, pos bigint, at string, detail string"


def stage_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Stage transitions from an append-only JSON-lines folder; the files bound a batch."""
    reader = spark.readStream.schema(STAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


_MOVE = "stage string, pos bigint, previous string, status string, legal boolean, started_at string, late boolean"


class StageState(StatefulProcessor):
    """Keeps the last status, place and start of each stage of one run; its state is one small row.

    A row that arrives after rows of later places is `late`: it is passed on without a verdict
    and leaves the state as it is, so it is never judged against a status from its future.
    Rows come in and go out as JSON texts, since each column of a row costs Python more than the work on it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "stages string")

    def handleInputRows(  # noqa: N802
        self, key: Any, rows: Iterator[Row], timerValues: Any  # noqa: N803
    ) -> Iterator[Row]:
        known = self._last.get()
        last = {stage: (*rest,) for stage, *rest in json.loads(known[0])} if known is not None else {}
        # One batch of one run; a batch is bounded by the trigger's file limit.
        events = json.loads(f"[{','.join(row[1] for row in rows)}]")
        moves = []
        for stage, status, pos, at in sorted(((*e[:2], int(e[2]), e[3]) for e in events), key=lambda e: e[2]):
            previous, started, seen = last.get(stage, ("pending", None, None))
            if seen is not None and pos < seen:
                moves.append((stage, pos, None, status, None, None, True))
                continue
            started = at if started is None else started
            moves.append((stage, pos, previous, status, status in STAGE_MOVES.get(previous, ()), started, False))
            last[stage] = (status, started, pos)
        self._last.update((json.dumps([(stage, *rest) for stage, rest in last.items()]),))
        yield Row("run_id", "moves")(*key, json.dumps(moves))

    def close(self) -> None:
        pass


def stage_moves(events: DataFrame) -> DataFrame:
    """Every transition with the status before it; rows that come too late for one are marked."""
    event = F.to_json(F.array("stage", "status", F.col("pos").cast("string"), "at"))
    moves = (
        events.select("run_id", event.alias("event"))
        .groupBy("run_id")
        .transformWithState(
            statefulProcessor=StageState(), outputStructType="run_id string, moves string", outputMode="Append", timeMode="None"
        )
    )
    return moves.select("run_id", F.inline(_moves("moves")))


def _moves(texts: str) -> Column:
    """The moves of a JSON text: a list of lists, whose items are in the order of `_MOVE`."""
    kinds = [part.split() for part in _MOVE.split(", ")]
    move = lambda m: F.struct(*(m[i].cast(kind).alias(name) for i, (name, kind) in enumerate(kinds)))
    return F.transform(F.from_json(texts, "array<array<string>>"), move)


def line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw capture lines with the file they came from."""
    reader = spark.readStream
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).withColumn("file", F.input_file_name())


def start_quarantine(
    lines: DataFrame, events_path: str, bad_path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Split each batch into valid events and kept bad lines; a retry overwrites its batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = parse_capture_lines(batch)
        parsed.where("is_valid").select("event.*").write.mode("overwrite").parquet(
            f"{events_path}/epoch={epoch}"
        )
        parsed.where("NOT is_valid").select("file", "value").write.mode("overwrite").parquet(
            f"{bad_path}/epoch={epoch}"
        )

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
