"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases where a label, made from a symbol and its left neighbour by
deterministic coin tossing (twice repeated), is a local maximum; a phrase is named by a hash of
what it holds, and the names are parsed again, level by level. Cuts depend on a few symbols
around them, so equal substrings get equal names inside, at whatever offset they stand. The
fingerprint keeps the least hashes of the names of the upper levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import texts_of

SKETCH = 64
#: Levels whose names make up the fingerprint: phrases of about ten and of about forty bytes.
LEVELS = (2, 3)
#: Bytes parsed at once; a longer text is parsed alone.
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _toss_table(size: int) -> np.ndarray:
    """Label of (symbol, left neighbour): twice the lowest differing bit, plus that bit."""
    own, left = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    low = (own ^ left) & -(own ^ left)
    bit = np.zeros_like(low)
    for i in range(size.bit_length()):
        bit[low == 1 << i] = i
    return (2 * bit + (own >> bit & 1)).astype(np.uint8)


_TOSS_256, _TOSS_16 = _toss_table(256).ravel(), _toss_table(16).ravel()
_TOSS_128 = _toss_table(128).ravel()


def _labels(symbols: np.ndarray, new_doc: np.ndarray) -> np.ndarray:
    """Labels below 8 of symbols that differ from their left neighbours.

    A document's first symbol has label 0 in each toss, whatever stands before it.
    """
    out = np.zeros(symbols.size, dtype=np.uint8)
    if symbols.dtype == np.uint8:
        out[1:] = _TOSS_256[(symbols[1:].astype(np.uint16) << np.uint16(8)) | symbols[:-1]]
        out[new_doc] = 0
    else:
        differ = symbols[1:] ^ symbols[:-1]
        low = differ & (~differ + np.uint64(1))
        # Equal neighbours stand at a border of documents only, where the label has no use.
        bit = np.maximum(np.frexp(low.astype(np.float64))[1] - 1, 0).astype(np.uint64)
        out[1:] = (2 * bit + ((symbols[1:] >> bit) & np.uint64(1))).astype(np.uint8)
        out[new_doc] = 0
        wide = out.astype(np.uint16)
        out[1:] = _TOSS_128[(wide[1:] << np.uint16(7)) | wide[:-1]]
        out[new_doc] = 0
    wide = out
    out = np.zeros(symbols.size, dtype=np.uint8)
    out[1:] = _TOSS_16[((wide[1:] & 15) << 4) | (wide[:-1] & 15)]
    out[new_doc] = 0
    return out


def _phrases(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each document's symbols, and the document of each phrase."""
    new_doc = np.empty(doc.size, dtype=bool)
    new_doc[0], new_doc[1:] = True, doc[1:] != doc[:-1]
    starts = new_doc.copy()
    starts[1:] |= symbols[1:] != symbols[:-1]
    head = np.flatnonzero(starts)
    runs = np.diff(head, append=symbols.size).astype(np.uint64)
    kept, kept_doc, kept_new = symbols[head], doc[head], new_doc[head]
    label = _labels(kept, kept_new)
    cuts = kept_new.copy()
    if label.size > 2:
        cuts[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~kept_new[2:]
    begin = np.flatnonzero(cuts)
    inside = np.arange(kept.size) - np.repeat(begin, np.diff(begin, append=kept.size))
    powers = np.full(int(inside.max(initial=0)) + 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    weighed = _mix(kept.astype(np.uint64) * _BASE + runs) * powers[inside]
    return _mix(np.add.reduceat(weighed, begin)), kept_doc[begin]


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the least `SKETCH` hashes (uint32, ascending) of its phrase names."""
    out = [np.empty(0, dtype=np.uint32)] * len(texts)
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= CHUNK:
            size += len(texts[last])
            last += 1
        lengths = np.array([len(t) for t in texts[first:last]])
        symbols = np.frombuffer(b"".join(texts[first:last]), dtype=np.uint8)
        doc = np.repeat(np.arange(last - first, dtype=np.int32), lengths)
        names, owners = [], []
        for level in range(1, max(LEVELS) + 1):
            if not symbols.size:
                break
            symbols, doc = _phrases(symbols, doc)
            if level in LEVELS:
                names.append((_mix(symbols + np.uint64(level)) >> np.uint64(32)).astype(np.uint64))
                owners.append(doc)
        if names:
            joined = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | np.concatenate(names))
            owner = (joined >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(owner, np.arange(last - first), side="right")
            begin = 0
            values = joined.astype(np.uint32)
            for i, end in enumerate(ends):
                out[first + i] = values[begin : min(end, begin + SKETCH)]
                begin = end
        first = last
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Estimated share of names in common: among the least of both, how many are in both.

    Two empty texts are alike (1.0); an empty text and another are not (0.0).
    """
    if not one.size and not two.size:
        return 1.0
    least = np.union1d(one, two)[:SKETCH]
    return float((np.isin(least, one) & np.isin(least, two)).sum() / least.size)


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by as many code points of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents follow each other by descending doc_id, null ids last, those of one id by a hash of
    the text; the last is followed by the first, a single one by itself. Rows equal in both are
    interchangeable. A null text is the empty one, whose fingerprint is "". An empty table gives
    no rows. The order is cut into ranges at keys of which there are a few for each partition;
    the first row of a range goes to the range before it too, so texts are shuffled once.
    """
    spark = docs.sparkSession
    order = ["_null", "_down", "_hash"]
    keyed = texts_of(docs, id_col, text_col).select(
        "doc_id",
        "text",
        F.col("doc_id").isNull().cast("int").alias("_null"),
        F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(0)).alias("_down"),
        F.xxhash64("text").alias("_hash"),
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = (
        keyed.select(*order)
        .repartitionByRange(ranges, *order)
        .groupBy(F.spark_partition_id().alias("_part"))
        .agg(F.min(F.struct(*order)).alias("_head"))
        .collect()
    )
    bounds = sorted({tuple(row["_head"]) for row in heads})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.array(bounds, dtype=[("n", "i4"), ("d", "i8"), ("h", "i8")])
        for batch in batches:
            keys = np.empty(batch.num_rows, dtype=lines.dtype)
            for field, at in (("n", 2), ("d", 3), ("h", 4)):
                keys[field] = batch.column(at).to_numpy()
            part = np.searchsorted(lines, keys, side="right") - 1
            prints = [
                s.astype("<u4").tobytes() for s in sketches(batch.column(1).cast(pa.binary()).to_pylist())
            ]
            columns = {name: batch.column(name) for name in ("doc_id", "text", *order)}
            columns["print"] = pa.array(prints, pa.binary())
            columns["part"] = pa.array(part, pa.int32())
            columns["guest"] = pa.array(np.zeros(part.size), pa.int32())
            yield (rows := pa.RecordBatch.from_pydict(columns))
            first = np.flatnonzero(lines[part] == keys)
            if first.size:
                guests = rows.take(pa.array(first)).to_pydict()
                guests["part"] = [(p - 1) % len(bounds) for p in guests["part"]]
                guests["guest"] = [1] * first.size
                yield pa.RecordBatch.from_pydict(guests, schema=rows.schema)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict | None = None
        for batch in batches:
            done: list[tuple[dict, dict]] = []
            for row in batch.to_pylist():
                if waiting is not None and waiting["part"] == row["part"]:
                    done.append((waiting, row))
                # Only the first guest of a range follows its last row.
                waiting = None if row["guest"] else row
            changed = [edited(row["text"], after["text"]).encode() for row, after in done]
            out = []
            for (row, after), text, sketch in zip(done, changed, sketches(changed), strict=True):
                own = np.frombuffer(row["print"], dtype="<u4")
                following = np.frombuffer(after["print"], dtype="<u4")
                out.append((
                    row["doc_id"], len(row["text"]), hashlib.sha256(text).hexdigest(), _hex(own),
                    _hex(sketch), likeness(own, sketch), likeness(own, following),
                ))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    dealt_rows = keyed.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        dealt, "doc_id long, text string, _null int, _down long, _hash long, print binary, part int, guest int"
    )
    return (
        dealt_rows.repartition("part")
        .sortWithinPartitions("part", "guest", *order)
        .mapInArrow(
            compared,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
    )
