"""Packing of token pieces into sequences by minimum bin slack.

The solver sees only how many pieces there are of each length, at most `capacity` numbers.
For one bin it fixes the longest piece left and finds by a subset-sum table (one bit for each
fill) the fullest combination of the lengths at hand. The combination stays the fullest as long
as its lengths last, so it is taken as often as the counts allow; each combination uses up one
length, which bounds their number by `capacity` at any size of the data.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import texts_of
from fleetlens.sources.scratch import materialize

CAPACITY = 2048
#: Fixed value: how byte-level vocabularies part a text before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "piece int, start long, length long, ids_crc32 long, part int, place long"


#: A run of so much white space is too deep for the faster library's search.
_LONG_RUN = re.compile(r"\s{10000}")


def encoder(vocabulary: bytes):
    """A function text to token ids (uint32) for a byte-level vocabulary file of `tokenizers`.

    Ids of such a file follow the order of its merges, so they serve as the ranks of a faster
    library, which gives the same ids for all but two kinds of texts: those that hold one of the
    file's added tokens, which is one id, and those with a very long run of white space. These go to
    `tokenizers` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    model = json.loads(vocabulary)
    added = [token["content"] for token in model["added_tokens"]]
    ranks = {
        bytes(shown[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in added
    }
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    whole: list[Tokenizer] = []

    def encode(text: str) -> np.ndarray:
        if not any(token in text for token in added) and not _LONG_RUN.search(text):
            return np.asarray(fast.encode_ordinary(text), dtype=np.uint32)
        if not whole:
            whole.append(Tokenizer.from_str(vocabulary.decode()))
        return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def cut(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document; the first piece takes what is over."""
    first = length % capacity
    return [0, *range(first, length, capacity)] if first else list(range(0, length, capacity))


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents of (doc_id, text): doc_id, piece, start, length, ids_crc32.

    `part` and `place` number the pieces of one length inside a task. `with_ids` adds the ids as
    little-endian bytes. The vocabulary file has a fixed size and goes out as a broadcast.
    """
    with open(tokenizer_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    # `ids` comes last, so that a caller who leaves it out gets the other columns alone.
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {PIECES}" + (", ids binary" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for number, start in enumerate(starts := cut(ids.size, capacity)):
                    end = starts[number + 1] if number + 1 < len(starts) else ids.size
                    own = ids[start:end].tobytes()
                    row = (doc_id, number, start, end - start, zlib.crc32(own), part, int(seen[end - start]))
                    rows.append((*row, own) if with_ids else row)
                    seen[end - start] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * (8 if with_ids else 7)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)]
            )

    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, at most as many of each as `counts` has, whose sum comes closest to `room`."""
    mask = (1 << (room + 1)) - 1
    reached, taken = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        for _ in range(min(counts[length], room // length)):
            more = (reached | reached << length) & mask
            if more == reached:
                break
            taken.append((length, reached))
            reached = more
        if reached >> room:
            break
    fill, chosen = reached.bit_length() - 1, []
    for length, before in reversed(taken):
        if not before >> fill & 1:
            chosen.append(length)
            fill -= length
    return chosen


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins) until every counted piece has its place."""
    left = {n: c for n, c in counts.items() if c}
    bins = []
    while left:
        longest = max(left)
        left[longest] -= 1
        lengths = [longest, *fullest(left, capacity - longest)]
        left[longest] += 1
        need = {n: lengths.count(n) for n in lengths}
        times = min(left[n] // k for n, k in need.items())
        bins.append((lengths, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


def _ranges(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, copies in a bin, first sequence, offset) by ranks of a length."""
    ranges, used, sequence = [], {}, 0
    for lengths, times in bins:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            copies, first = lengths.count(n), used.get(n, 0)
            used[n] = first + copies * times
            ranges.append((n, first, used[n] - 1, copies, sequence, offset))
            offset += copies * n
        sequence += times
    return ranges


def place_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (a written table with length, part and place) with sequence_id and offset.

    To the driver goes the count of each length (`capacity` rows at most), back comes the table
    of combinations: at most `capacity` of them, each of fewer than sqrt(2 * capacity) lengths.
    """
    tallies = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    counted = tallies.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    ranges = _ranges(combinations({row["length"]: row["n"] for row in counted}, capacity))
    names = "length long, _first long, _last long, _copies long, _sequence long, _offset long"
    table = spark.createDataFrame(ranges, names)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tallies.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("place"))
    inside = F.col("_rank") - F.col("_first")
    return (
        ranked.join(
            F.broadcast(table.withColumnRenamed("length", "_length")),
            (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")),
        )
        .withColumn("sequence_id", F.col("_sequence") + F.floor(inside / F.col("_copies")))
        .withColumn("offset", F.col("_offset") + F.pmod(inside, F.col("_copies")) * F.col("length"))
        .drop("_base", "_rank", "_length", "_first", "_last", "_copies", "_sequence", "_offset", "part", "place")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every document's tokens, placed in as few sequences of `capacity` tokens as found.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids` on demand, as
    little-endian bytes, for writing out the sequences). A null or empty text is its end id
    alone. Repeated rows are packed each on their own; an empty table gives no rows. Ids keep
    their type.
    """
    spark = docs.sparkSession
    found = token_pieces(texts_of(docs, id_col, text_col), tokenizer_path, capacity, end_id, with_ids)
    placed = place_pieces(spark, materialize(found, "pieces"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns, *(["ids"] if with_ids else []))
