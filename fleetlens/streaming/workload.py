"""Operation rollups and amplification kept up to date as event files arrive."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from itertools import batched
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.workload import MIN_REPETITIONS, OPERATION, amplification_class

EVENT_SCHEMA = (
    "app_id string, run_id string, node_id string, phase string, sequence bigint, duration_us bigint, "
    "query_id string, statement_class string, rowcount bigint, bind string, at timestamp"
)
PIECE_WIDTH = 4096
SLOTS = 1024


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Described events from JSON files as they appear below `path`."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def operation_rollup(events: DataFrame) -> DataFrame:
    """Running counts and duration per (operation, query), for update mode.

    Each batch is combined by key before the shuffle, so a hot operation costs one row per
    task and query.
    """
    return events.groupBy(*OPERATION, "query_id").agg(
        F.count("*").alias("executions"), F.sum("duration_us").alias("duration_us")
    )


_EVENT = ["sequence", "query_id", "statement_class", "rowcount", "bind"]
_PIECE = (
    "app_id string, run_id string, node_id string, phase string, piece bigint, opened int, "
    "query_id string, executions bigint, first_sequence bigint, low_bind string, high_bind string, "
    "has_null_bind boolean, near_query string, near_class string, near_rowcount string, "
    "last_sequence bigint, last_query string, last_class string, last_rowcount string"
)
_FOUND = (
    "app_id string, run_id string, node_id string, phase string, child_query string, repetitions bigint, "
    "same_binds boolean, parent_query string, parent_class string, parent_rowcount string"
)
_SENT = "slot bigint, pieces string"
# A piece is named by its operation, its number and the slot of the operation; an event goes on with its time.
_NODE = OPERATION.index("node_id")
_UNTIL = len(OPERATION) + 2
_HELD_TOGETHER = 4096


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _as_rows(rows: list[tuple], schema: str) -> Iterator[Row]:
    shape = Row(*_names(schema))
    return (shape(*row) for row in rows)


def _text(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"))


def _parsed(frames: Iterator[pd.DataFrame], column: str) -> list:
    """The JSON texts of a column, read at once."""
    return json.loads(f"[{','.join(text for frame in frames for text in frame[column])}]")


class PieceBuffers(StatefulProcessor):
    """Holds the events of pieces (ranges of sequence numbers) of operations while they are open.

    A key is a slot, to which pieces are dealt by hash: a call to the state takes longer than the work
    on an event, so what a batch brings to the pieces of a slot is kept with a few calls, as JSON texts.
    The first events of a piece send a row `opened` = 1. A piece is open until the time of its last
    event plus `gap`; a slot has one timer, for the piece that ends first. When the watermark passes
    it, each piece that has ended is summarized once, with a row for each query and `opened` = -1 in
    one of them, and its state goes. Rows are sent by slots of operations.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._events = handle.getListState("events", "events string")
        self._open = handle.getValueState("open", "open string")

    def _known(self) -> dict[tuple, int]:
        known = self._open.get()
        return {tuple(piece): until for piece, until in json.loads(known[0])} if known is not None else {}

    def _keep(self, still: dict[tuple, int], timer: int | None) -> None:
        self._open.update((_text(list(still.items())),))
        until = min(still.values())
        if timer is not None and timer != until:
            self._handle.deleteTimer(timer)
        if timer != until:
            self._handle.registerTimer(until)

    def handleInputRows(  # noqa: N802
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        # A filter before would be moved below the watermark, and a row of no node would not move the clock.
        fresh = [event for event in _parsed(rows, "event") if event[_NODE] is not None]
        if not fresh:
            return
        still = self._known()
        timer = min(still.values(), default=None)
        opened = []
        for event in fresh:
            piece, until = tuple(event[:_UNTIL]), int(event[_UNTIL])
            if piece not in still:
                opened.append((piece[-1], piece[: len(OPERATION)]))
                still[piece] = until
            elif still[piece] < until:
                still[piece] = until
        self._events.appendList([(_text(part),) for part in batched(fresh, _HELD_TOGETHER)])
        self._keep(still, timer)
        yield _sent(opened)

    def handleExpiredTimer(  # noqa: N802
        self, key: Any, timerValues: Any, expiredTimerInfo: Any  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        watermark = timerValues.getCurrentWatermarkInMs()
        still = self._known()
        ended: dict[tuple, list] = {p: [] for p, until in still.items() if until <= passed or until < watermark}
        kept = []
        for (text,) in self._events.get():
            for event in json.loads(text):
                held = ended.get(tuple(event[:_UNTIL]))
                if held is None:
                    kept.append(event)
                else:
                    held.append((int(event[_UNTIL + 1]), *event[_UNTIL + 2 :]))
        still = {p: until for p, until in still.items() if p not in ended}
        if still:
            self._events.put([(_text(part),) for part in batched(kept, _HELD_TOGETHER)])
            self._keep(still, None)
        else:
            self._events.clear()
            self._open.clear()
        yield _sent(
            [
                (piece[-1], row)
                for piece, held in ended.items()
                for row in _summary((*piece[: len(OPERATION)], int(piece[-2])), sorted(held, key=lambda r: r[0]))
            ]
        )

    def close(self) -> None:
        pass


def _sent(rows: list[tuple[str, tuple]]) -> pd.DataFrame:
    """Rows of pieces, those of the operations of a slot in one text; an operation alone is a piece it opens."""
    by_slot: dict[str, list] = {}
    for slot, row in rows:
        by_slot.setdefault(slot, []).append(row)
    return pd.DataFrame([(int(slot), _text(some)) for slot, some in by_slot.items()], columns=_names(_SENT))


def _summary(key: Any, held: list[tuple]) -> list[tuple]:
    """Rows of a closed piece from its events in order."""
    found: dict[str, dict] = {}
    before: tuple = (None, None, None)
    for sequence, query, kind, rowcount, bind in held:
        entry = found.setdefault(query, {"executions": 0, "first": sequence, "binds": set(), "near": before})
        entry["executions"] += 1
        entry["binds"].add(bind)
        before = (query, kind, rowcount)
    rows = []
    for query, entry in found.items():
        binds = [b for b in entry["binds"] if b is not None]
        rows.append(
            (*key, 0 if rows else -1, query, entry["executions"], entry["first"])
            + (min(binds, default=None), max(binds, default=None), None in entry["binds"])
            + (*entry["near"], held[-1][0], *before)
        )
    return rows


def _merged(known: tuple | None, piece: int, summary: list) -> tuple:
    """What is kept of a query, with the summary of one more piece."""
    executions, first, low, high, with_null, *near = summary
    if known is not None:
        n, known_first, known_low, known_high, known_null, *place = known
        executions += n
        low = min((b for b in (low, known_low) if b is not None), default=None)
        high = max((b for b in (high, known_high) if b is not None), default=None)
        with_null = with_null or known_null
        if known_first < first:
            first, (piece, *near) = known_first, place
    return (executions, first, low, high, with_null, piece, *near)


class Operations(StatefulProcessor):
    """Merges the summaries of one operation's pieces, and answers when none of them is open.

    What is kept is a row for each query and one for each closed piece; it goes with the answer.
    """

    def __init__(self, min_repetitions: int) -> None:
        self._least = min_repetitions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "open bigint")
        self._queries = handle.getMapState(
            "queries",
            "query_id string",
            "executions bigint, first_sequence bigint, low string, high string, with_null boolean, "
            "piece bigint, near_query string, near_class string, near_rowcount string",
        )
        self._lasts = handle.getMapState(
            "lasts", "piece bigint", "sequence bigint, query_id string, statement_class string, rowcount string"
        )

    def handleInputRows(  # noqa: N802
        self, key: Any, rows: Iterator[Row], timerValues: Any  # noqa: N803
    ) -> Iterator[Row]:
        known = self._open.get()
        still = known[0] if known is not None else 0
        # What is kept is read and written at most once for each query and piece of a batch.
        queries: dict[str, tuple | None] = {}
        lasts: dict[int, tuple] = {}
        for _, _, _, _, piece, opened, query, *summary, sequence, last_query, last_class, last_rowcount in rows:
            still += opened
            if opened == 1:
                continue
            if query not in queries:
                kept = known is not None and self._queries.containsKey((query,))
                queries[query] = tuple(self._queries.getValue((query,))) if kept else None
            near = summary[-3:]
            if near[0] is None and known is not None and self._lasts.containsKey((piece,)):
                # The piece had been closed before and got later events since.
                summary[-3:] = self._lasts.getValue((piece,))[1:]
            queries[query] = _merged(queries[query], piece, summary)
            lasts[piece] = (sequence, last_query, last_class, last_rowcount)
        if still:
            self._open.update((still,))
            for query, entry in queries.items():
                self._queries.updateValue((query,), entry)
            for piece, last in lasts.items():
                self._lasts.updateValue((piece,), last)
            return
        if known is not None:
            queries = {q[0]: tuple(v) for q, v in self._queries.iterator()} | queries
            lasts = {p[0]: tuple(v) for p, v in self._lasts.iterator()} | lasts
            for state in (self._open, self._queries, self._lasts):
                state.clear()
        yield from _as_rows(self._answer(key, queries, lasts), _FOUND)

    def _answer(self, key: Any, queries: dict[str, tuple], lasts: dict[int, tuple]) -> list[tuple]:
        often = [(query, entry) for query, entry in queries.items() if entry[0] >= self._least]
        if not often:
            return []
        ends = sorted(lasts.items())
        places = [p for p, _ in ends]
        rows = []
        for query, (executions, _first, low, high, with_null, piece, *near) in often:
            if near[0] is None:
                at = bisect_left(places, piece)
                near = ends[at - 1][1][1:] if at else near
            if near[0] is not None:
                rows.append((*key, query, executions, low is None or (low == high and not with_null), *near))
        return rows

    def close(self) -> None:
        pass


class _Part:
    """What a slot's map state holds of the operation at hand."""

    def __init__(self, state: Any, slot: OperationSlots) -> None:
        self._state, self._slot = state, slot

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return self._slot.stored and self._state.containsKey((*self._slot.operation, *key))

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        return self._state.getValue((*self._slot.operation, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self._slot.stored = True
        self._state.updateValue((*self._slot.operation, *key), value)

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter(self._slot.entries(self._state))

    def clear(self) -> None:
        for key, _ in self._slot.entries(self._state):
            self._state.removeKey((*self._slot.operation, *key))


class OperationSlots(StatefulProcessor):
    """`Operations` for all operations of a slot, to which they are dealt by hash.

    One value holds the open pieces of each operation, and whether the maps have rows of it; what the maps
    hold is read by key, and as a whole only in a batch that completes an operation with rows in them.
    """

    def __init__(self, min_repetitions: int) -> None:
        self._each = Operations(min_repetitions)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._slot = handle.getValueState("operations", "operations string")
        self._each.init(self)

    def getValueState(self, name: str, schema: str) -> OperationSlots:  # noqa: N802
        return self

    def getMapState(self, name: str, key: str, value: str) -> _Part:  # noqa: N802
        whose = "app_id string, run_id string, node_id string, phase string"
        return _Part(self._handle.getMapState(name, f"{whose}, {key}", value), self)

    def get(self) -> tuple | None:
        known = self._operations.get(self.operation)
        return known[:1] if known is not None else None

    def update(self, value: tuple) -> None:
        self._operations[self.operation] = value

    def clear(self) -> None:
        self._operations.pop(self.operation)

    def entries(self, state: Any) -> list[tuple[tuple, tuple]]:
        if not self.stored:
            return []
        if id(state) not in self._read:
            found = self._read[id(state)] = {}
            for key, value in state.iterator():
                found.setdefault(tuple(key)[:4], []).append((tuple(key)[4:], tuple(value)))
        return self._read[id(state)].get(self.operation, [])

    def handleInputRows(  # noqa: N802
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any  # noqa: N803
    ) -> Iterator[pd.DataFrame]:
        pieces: dict[tuple, list] = {}
        width = len(OPERATION)
        blank = (None,) * (len(_names(_PIECE)) - width - 2)
        for sent in _parsed(rows, "pieces"):
            for piece in sent:
                row = piece if len(piece) > width else (*piece, None, 1, *blank)
                pieces.setdefault(tuple(piece[:width]), []).append(row)
        known = self._slot.get()
        self._operations = {tuple(op): tuple(v) for op, v in json.loads(known[0])} if known is not None else {}
        self._read: dict[int, dict] = {}
        found: list[Row] = []
        for self.operation, some in pieces.items():
            self.stored = self._operations.get(self.operation, (0, False))[1]
            found.extend(self._each.handleInputRows(self.operation, iter(some), timerValues))
            if self.operation in self._operations:
                self._operations[self.operation] = (self._operations[self.operation][0], self.stored)
        if self._operations:
            self._slot.update((_text(list(self._operations.items())),))
        else:
            self._slot.clear()
        yield pd.DataFrame(found, columns=_names(_FOUND))

    def close(self) -> None:
        pass


def amplification(
    events: DataFrame,
    gap: str = "10 minutes",
    delay: str = "1 minute",
    width: int = PIECE_WIDTH,
    min_repetitions: int = MIN_REPETITIONS,
    slots: int = SLOTS,
) -> DataFrame:
    """Stream of amplifications, each operation's once it is complete.

    An operation is complete when the watermark (`delay` behind the latest event) lies `gap` after
    its last event; then all of its state goes. Files may come in any order within the delay. An
    operation is cut into pieces of `width` sequence numbers, whose events are held and summarized
    apart, so a hot one spreads over the cluster; only a row for each query of each piece meets in
    one place. The events that are open at a time should be some ten thousand for each of the `slots`
    at most, since a task takes those of a slot at once. Rows without a node_id move the clock and nothing else. Events of an operation that
    come more than `gap` after the others are one of their own, as are their answers.
    """
    sequence = F.coalesce("sequence", F.lit(0))
    piece = F.floor(sequence / width)
    until = F.coalesce(F.unix_millis(F.col("at") + F.expr(f"INTERVAL {gap}")), F.lit(0))
    owner = F.pmod(F.xxhash64(*OPERATION), F.lit(slots))
    place = [*(F.col(c) for c in OPERATION), piece, owner, until, sequence]
    event = F.to_json(F.array(*(c.cast("string") for c in [*place, *(F.col(c) for c in _EVENT[1:])])))
    slot = F.pmod(F.xxhash64(*OPERATION, piece), F.lit(slots))
    pieces = (
        events.withWatermark("at", delay)
        .select(slot.alias("slot"), event.alias("event"), "at")
        .groupBy("slot")
        .transformWithStateInPandas(
            statefulProcessor=PieceBuffers(), outputStructType=_SENT, outputMode="Append", timeMode="EventTime"
        )
    )
    found = pieces.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=OperationSlots(min_repetitions), outputStructType=_FOUND, outputMode="Append", timeMode="None"
    )
    parent = F.struct(
        F.col("parent_query").alias("query_id"),
        F.col("parent_class").alias("statement_class"),
        F.col("parent_rowcount").cast("bigint").alias("rowcount"),
    )
    return found.select(
        *OPERATION,
        "parent_query",
        "child_query",
        "repetitions",
        amplification_class(F.col("repetitions"), F.col("same_binds"), parent).alias("classification"),
    )
