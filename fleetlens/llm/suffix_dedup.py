"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are sorted through `WINDOW` bytes only, by most-significant-digit passes in which a
digit is a hash of a part of the window and a pass goes on only with groups of equal digits:

* The first digit of a window is the `ANCHOR` bytes inside it whose hash is least, so equal
  windows have their anchor at the same offset, and neighbouring windows mostly share one. One
  row for each anchor stands for all windows around it, about one in 75 windows.
* Later digits are ever longer strings around the anchor. Windows of an anchor are kept in runs
  (cells of `CELLS` offsets). A run is settled as repeated when the whole string that its windows
  cover occurs again around an equal anchor, and as unique when the string that all windows of
  its cell have in common occurs nowhere else. Only runs that are neither are cut into smaller
  cells; in the last pass a cell is one window, and equal groups are the repeated windows.

All grouping is counting with combination before the shuffle; no group is ever gathered. Hashes
of whole runs have 128 bits, those that only send runs on to a later pass have 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.llm.common import portions, text_keys
from fleetlens.llm.hashing import Rolling, mix
from fleetlens.sources.scratch import materialize

WINDOW = 200
ANCHOR = 50
#: Offsets of a window's start before its anchor, by pass; the first cell holds all of them.
CELLS = (26, 5, 1)
#: Window starts worked on at once; a longer text is done in several overlapping parts.
CHUNK = 1 << 18
_U = np.uint64


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by least values to both sides within blocks."""
    size = keys.size
    blocks = -(-size // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:size] = keys
    rows = padded.reshape(blocks, width)
    to_right = np.minimum.accumulate(rows, axis=1).ravel()
    to_left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(to_left[: size - width + 1], to_right[width - 1 : size])


def _anchor_runs(
    texts: list[bytes], window: int, anchor: int, digests: bool
) -> Iterator[tuple[np.ndarray, ...]]:
    """For parts of `texts`: text number, anchor place, first and last window start, hashes.

    Places count from the text's start. Without `digests` only the anchors' hashes are made.
    """
    width = window - anchor + 1
    todo = [
        (i, s, min(len(t), s + CHUNK + window - 1))
        for i, t in enumerate(texts)
        for s in range(0, max(len(t) - window + 1, 0), CHUNK)
    ]
    rolling = Rolling(2 * CHUNK + 2 * window)
    first = 0
    while first < len(todo):
        last, size = first, 0
        while last < len(todo) and (last == first or size + todo[last][2] - todo[last][1] <= CHUNK):
            size += todo[last][2] - todo[last][1]
            last += 1
        part, first = todo[first:last], last
        data = np.frombuffer(b"".join(memoryview(texts[i])[s:e] for i, s, e in part), dtype=np.uint8)
        lengths = np.array([e - s for _, s, e in part])
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        sums = rolling.sums(data, 0)
        places = np.arange(size - anchor + 1)
        cores = rolling.between(sums, 0, places, places + anchor)
        ranked = (mix(cores) & _U(0xFFFFFFFF00000000)) | places.astype(np.uint64)
        chosen = _sliding_least(ranked, width) & _U(0xFFFFFFFF)
        counts = lengths - window + 1
        starts = np.repeat(begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        owner = np.repeat(np.arange(len(part)), counts)
        chosen = chosen[starts].astype(np.int64)
        new = np.empty(starts.size, dtype=bool)
        new[0] = True
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], starts.size) - 1
        at, low, high, owner = chosen[head], starts[head], starts[tail], owner[head]
        core = cores[at].view(np.int64)
        if not digests:
            yield (core,)
            continue
        spread = mix(((at - high) * (window + 1) + (at - low)).astype(np.uint64) + _U(1))
        others = rolling.sums(data, 1)
        c1 = rolling.between(sums, 0, low, high + window) ^ spread
        c2 = rolling.between(others, 1, low, high + window) + spread
        shift = np.array([s for _, s, _ in part])[owner] - begins[owner]
        text = np.array([i for i, _, _ in part])[owner]
        yield text, at + shift, low + shift, high + shift, core, c1.view(np.int64), c2.view(np.int64)


def _cell_rows(
    rows: list[tuple[int, int, int, list]], data: list[bytes], width: int, window: int
) -> dict[str, np.ndarray]:
    """Cells of `width` offsets of the open runs of each anchor, hashed.

    A row is (number, anchor place, first byte's place in the text, runs).
    """
    joined = np.frombuffer(b"".join(data), dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(d) for d in data])[:-1])).astype(np.int64)
    number, low, high, core_low, core_high, mine = [], [], [], [], [], []
    for (i, place, origin, runs), begin in zip(rows, begins, strict=True):
        for run_low, run_high, own in runs:
            for cell in range((place - run_high) // width, (place - run_low) // width + 1):
                number.append(i)
                mine.append(own)
                low.append(begin + max(run_low, place - cell * width - width + 1) - origin)
                high.append(begin + min(run_high, place - cell * width) - origin)
                core_low.append(begin + place - cell * width - origin)
                core_high.append(begin + place - cell * width - width + 1 + window - origin)
    rolling = Rolling(joined.size + 1)
    sums, others = rolling.sums(joined, 0), rolling.sums(joined, 1)
    low, high, core_low, core_high = (np.array(x, dtype=np.int64) for x in (low, high, core_low, core_high))
    number = np.array(number, dtype=np.int64)
    place = np.array([r[1] - r[2] for r in rows], dtype=np.int64)
    local = begins - np.array([r[2] for r in rows], dtype=np.int64)
    cell = (place[number] + begins[number] - high) // width
    spread = mix(((place[number] + begins[number] - high) * (window + 1) + (place[number] + begins[number] - low)).astype(np.uint64) + _U(1))
    core = rolling.between(sums, 0, core_low, core_high) ^ mix(cell.astype(np.uint64) + _U(3))
    c1 = rolling.between(sums, 0, low, high + window) ^ spread
    c2 = rolling.between(others, 1, low, high + window) + spread
    return {
        "number": number, "low": low - local[number], "high": high - local[number], "mine": np.array(mine, dtype=bool),
        "core": core.view(np.int64), "c1": c1.view(np.int64), "c2": c2.view(np.int64),
    }


def _settle(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(repeated runs, open runs) of `rows`: k1, k2, place, low, high, mine, core, c1, c2.

    An open run is one whose whole string is single while its core is not. One row of each
    repeated string stays beside it as a witness (`mine` false) if it shares the core.
    """
    own = F.struct("k1", "k2", "place", "low", "high")
    kinds = materialize(
        rows.groupBy("core", "c1", "c2").agg(
            F.count("*").alias("n"), F.max("mine").alias("mine"), F.min(own).alias("own")
        ),
        label,
    )
    cores = kinds.groupBy("core").agg(
        F.count("*").alias("_kinds"), F.max((F.col("n") == 1) & F.col("mine")).alias("_open")
    )
    repeated = (
        rows.where("mine")
        .join(kinds.where("n > 1").select("core", "c1", "c2"), ["core", "c1", "c2"], "left_semi")
        .select("k1", "k2", "low", "high")
    )
    left = kinds.join(cores.where("_kinds > 1 and _open").select("core"), "core", "left_semi").select(
        "own.*", (F.col("mine") & (F.col("n") == 1)).alias("mine")
    )
    return repeated, left


def _listed(repeated: DataFrame, name: str) -> DataFrame:
    """Repeated runs of each text in one list, which the length of the text bounds."""
    return repeated.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias(name))


def _digest(text: bytes, runs: list[tuple[int, int]], window: int, keep: bool) -> dict:
    """What is left of a text without the windows that start in `runs`.

    `kept` (on demand) holds every character of which at least one byte is left.
    """
    spans: list[list[int]] = []
    for low, high in sorted(runs):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high + window)
        else:
            spans.append([low, high + window])
    bytes_left, characters, at, begin = hashlib.sha256(), [], 0, 0
    for first, end in [*spans, [len(text), len(text)]]:
        bytes_left.update(text[at:first])
        if keep:
            whole = first
            while first > at and whole < len(text) and text[whole] & 0xC0 == 0x80:
                whole += 1
            characters.append(text[begin:whole])
            begin = end
            while end < len(text) and begin > whole and text[begin] & 0xC0 == 0x80:
                begin -= 1
        at = end
    return {
        "n_bytes": len(text), "n_removed": sum(e - f for f, e in spans), "n_spans": len(spans),
        "kept_sha256": bytes_left.hexdigest(), "spans": [{"first": f, "end": e} for f, e in spans],
        "kept": b"".join(characters).decode() if keep else None,
    }


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_DONE = [
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()), ("spans", _SPANS), ("kept", pa.string()),
]
_OPEN = [
    ("text", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64()), ("origin", pa.int64()),
    ("runs", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("mine", pa.bool_())]))),
    ("settled", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), ("bytes", pa.binary()),
]
_DONE_SQL = (
    "n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<first:long,end:long>>, kept string"
)
_OPEN_SQL = (
    "text string, k1 long, k2 long, place long, origin long, "
    "runs array<struct<low:long,high:long,mine:boolean>>, settled array<struct<low:long,high:long>>, bytes binary"
)
_ROWS = "k1 long, k2 long, place long, low long, high long, mine boolean, core long, c1 long, c2 long"


def removed_spans(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    text_col: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """(rest, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): what repeats in each document.

    `rest` is a struct of all other columns of `docs`, which pass through untouched. A byte goes if
    a `window`-byte string that covers it starts anywhere else too, in the same document or
    another; strings are judged on the whole input and never run across documents. `spans` are the
    maximal removed runs as [first byte, end); `kept` is the text that is left (with `keep_text`,
    else null), where a character stays if one of its bytes does. A null text is the empty one;
    texts shorter than the window lose nothing; repeated rows count as places of their own. An
    empty table gives no rows.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    keyed = docs.select(
        F.struct(*others, F.lit(0).alias("_")).alias("rest"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    keyed = keyed.select("rest", "text", *text_keys(F.col("text")))
    long_enough = keyed.where(F.octet_length("text") >= window)
    rest = StructType().add("rest", keyed.schema["rest"].dataType, True)
    done_type = StructType(rest.fields + StructType.fromDDL(_DONE_SQL).fields)
    more_type = StructType(done_type.fields + StructType.fromDDL(_OPEN_SQL).fields)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (core,) in _anchor_runs(batch.column(0).cast(pa.binary()).to_pylist(), window, anchor, False):
                values, counts = np.unique(core, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["core", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for text, place, low, high, core, c1, c2 in _anchor_runs(texts, window, anchor, True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (k1[text], k2[text], place, low, high, np.ones(text.size, bool), core, c1, c2)],
                    names=["k1", "k2", "place", "low", "high", "mine", "core", "c1", "c2"],
                )

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "text")):
            out, owners = [], []
            columns = {n: batch.column(n).to_pylist() for n in ("text", "k1", "k2", "settled", "open")}
            for i, (text, k1, k2, settled, todo) in enumerate(zip(*columns.values(), strict=True)):
                data = text.encode()
                by_place: dict[int, list] = {}
                for r in todo or []:
                    by_place.setdefault(r["place"], []).append(r)
                for place, own in by_place.items():
                    low, high = min(r["low"] for r in own), max(r["high"] for r in own)
                    runs = [{n: r[n] for n in ("low", "high", "mine")} for r in own]
                    part = data[low : high + window]
                    out.append({"k1": k1, "k2": k2, "place": place, "origin": low, "runs": runs, "bytes": part})
                    owners.append(None)
                if any(r["mine"] for r in todo or []):
                    out.append({"text": text, "k1": k1, "k2": k2, "settled": settled})
                else:
                    out.append(_digest(data, [(r["low"], r["high"]) for r in settled or []], window, keep_text))
                owners.append(i)
            made = pa.RecordBatch.from_pylist(out, schema=pa.schema(_DONE + _OPEN))
            passed = batch.column("rest").take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([passed, *made.columns], names=["rest", *made.schema.names])

    def cells(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.to_pylist()
                if not found:
                    continue
                rows = [
                    (i, r["place"], r["origin"], [(x["low"], x["high"], x["mine"]) for x in r["runs"]])
                    for i, r in enumerate(found)
                ]
                out = _cell_rows(rows, [r["bytes"] for r in found], width, window)
                pick = {n: np.array([r[n] for r in found], dtype=np.int64)[out["number"]] for n in ("k1", "k2", "place")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (*pick.values(), out["low"], out["high"], out["mine"], out["core"], out["c1"], out["c2"])],
                    names=["k1", "k2", "place", "low", "high", "mine", "core", "c1", "c2"],
                )

        return run

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "text")):
            columns = [batch.column(n).to_pylist() for n in ("text", "settled", "later")]
            out = [
                _digest(text.encode(), [(r["low"], r["high"]) for r in (now or []) + (later or [])], window, keep_text)
                for text, now, later in zip(*columns, strict=True)
            ]
            made = pa.RecordBatch.from_pylist(out, schema=pa.schema(_DONE))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *made.columns], names=["rest", *made.schema.names])

    seen = long_enough.select("text").mapInArrow(cores, "core long, n long")
    again = materialize(seen.groupBy("core").agg(F.sum("n").alias("n")).where("n > 1").select("core"), "cores")
    rows = materialize(
        long_enough.select("text", "k1", "k2").mapInArrow(runs, _ROWS).join(again, "core", "left_semi"), "runs"
    )
    repeated, left = _settle(rows, "kinds")
    marks = (
        repeated.distinct()
        .select("k1", "k2", F.struct("low", "high").alias("settled"), F.lit(None).alias("open"))
        .unionAll(left.select("k1", "k2", F.lit(None), F.struct("place", "low", "high", "mine")))
        .groupBy("k1", "k2")
        .agg(F.collect_list("settled").alias("settled"), F.collect_list("open").alias("open"))
    )
    first = materialize(keyed.join(marks, ["k1", "k2"], "left").mapInArrow(opened, more_type), "texts")
    contexts = first.where("place is not null").select("k1", "k2", "place", "origin", "runs", "bytes").dropDuplicates(["k1", "k2", "place"])
    current, found = contexts, []
    for width in CELLS:
        rows = materialize(current.mapInArrow(cells(width), _ROWS), "cells")
        repeated, left = _settle(rows, "kinds")
        found.append(repeated)
        lists = left.groupBy("k1", "k2", "place").agg(F.collect_list(F.struct("low", "high", "mine")).alias("runs"))
        current = contexts.drop("runs").join(lists, ["k1", "k2", "place"]).select(*contexts.columns)
    later = _listed(reduce(DataFrame.unionAll, found), "later")
    waiting = first.where("text is not null").select("rest", "text", "k1", "k2", "settled")
    return (
        first.where("kept_sha256 is not null")
        .select(*done_type.names)
        .unionAll(waiting.join(later, ["k1", "k2"], "left").mapInArrow(finished, done_type))
    )


def dedup_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document."""
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return removed_spans(docs.select(id_col, text_col), window, text_col=text_col).select(
        F.col(f"rest.`{id_col}`").alias("doc_id"), *columns
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """`docs`, same columns, with the text that is left of each document."""
    done = removed_spans(docs, window, text_col=text_col, keep_text=True)
    return done.select(
        *(F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns)
    )
