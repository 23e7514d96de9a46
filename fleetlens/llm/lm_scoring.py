"""Scores of documents by the difference of their cross-entropy under two matched word models.

Each word is judged behind the word before it, over one vocabulary of all words of all documents;
the target model counts the target's documents, the background model all. What is counted, words and
pairs of words, grows with the corpus and stays on the executors.

Documents are dealt into batches of some megabytes. A batch sends each of its grams once, with how
often target and other documents of it have the gram, as sorted runs of differences; a bucket of grams
adds up what all batches sent and answers each with the corpus's counts in the same order, so no gram
travels back. The batch, read again from the shuffle that dealt the documents, finds its grams in the
same order and sums the losses of each document. A gram that very many documents have is one
number of each batch like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import portions, texts_of
from fleetlens.llm.hashing import Rolling, mix, words

#: Weight of an even distribution over the vocabulary, in words.
WORD_PRIOR = 16.0
#: Bytes of text of a batch, and so of text whose grams a bucket holds at first sight.
BATCH = 1 << 23
#: Bits of a gram's name; the lowest one tells pairs from words.
BITS = 56
#: Different words a task gathers before it passes them on.
HELD = 1 << 18
#: What stands before the first and behind the last word of a text, as hashes.
_FIRST, _LAST = np.uint64(1), np.uint64(2)


def _texts(batch: pa.RecordBatch | pa.Table) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram) of every gram in turn, and the number of tokens of each text.

    Grams are each word (and the start) as what stands before another, and each pair of neighbours;
    tokens are a text's words and its end. A text without a word has neither.
    """
    texts_at, grams, tokens = [], [], np.zeros(len(texts), dtype=np.int64)
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= 1 << 20:
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"\n".join(texts[first:last]), dtype=np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[first:last])])
        at, hashed = words(data, Rolling(data.size + 1))
        n_words = np.diff(np.searchsorted(at, begins))
        some = np.flatnonzero(n_words)
        tokens[first + some] = n_words[some] + 1
        text = np.repeat(first + some, n_words[some] + 1).astype(np.int32)
        ends = np.cumsum(n_words[some])
        before = np.insert(hashed, ends - n_words[some], _FIRST)
        behind = np.insert(hashed, ends, _LAST)
        single = mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + _FIRST) >> np.uint64(64 - BITS)
        pair = mix(before * np.uint64(0x9E3779B97F4A7C15) + behind) >> np.uint64(64 - BITS)
        texts_at += [text, text]
        grams += [single & ~np.uint64(1), pair | np.uint64(1)]
        first = last
    if not grams:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint64), tokens
    return np.concatenate(texts_at), np.concatenate(grams), tokens


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by their bytes' places, as many as the largest needs: zeros stand together."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def vocabulary_size(docs: DataFrame) -> int:
    """How many different words all texts have, and one more for the end of a text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, dtype=np.uint64)
        for batch in batches:
            for part in portions(batch, "text"):
                data = np.frombuffer(b"\n".join(_texts(part)), dtype=np.uint8)
                held = np.union1d(held, words(data, Rolling(data.size + 1))[1])
                if held.size > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], names=["word"])
                    held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64))], names=["word"])

    return docs.select("text").mapInArrow(found, "word long").distinct().count() + 1


def _cuts(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an even share of all names, begins in sorted grams."""
    bounds = np.arange(buckets + 1, dtype=np.uint64) << np.uint64(BITS - buckets.bit_length() + 1)
    return np.searchsorted(grams, bounds)


def counted_grams(dealt: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, grams, target, background): each batch's grams with its own counts.

    `dealt` has batch, doc_id and text, `target` batch and the ids in it. Grams are sorted and sent
    as differences.
    """

    def counted(docs: pa.Table, chosen: pa.Table) -> pa.Table:
        names = ["batch", "bucket", "grams", "target", "background"]
        rows: list[tuple] = []
        if docs.num_rows:
            ids = chosen.column("doc_id").combine_chunks()
            inside = pc.is_in(docs.column("doc_id"), value_set=ids, skip_nulls=True).to_numpy(zero_copy_only=False)
            text, own, _tokens = _grams(_texts(docs))
            grams, every = np.unique(own, return_counts=True)
            good = np.zeros(grams.size, dtype=np.int64)
            held, n = np.unique(own[inside[text].astype(bool)], return_counts=True)
            good[np.searchsorted(grams, held)] = n
            cuts = _cuts(grams, buckets)
            steps = np.diff(grams, prepend=np.uint64(0))
            for bucket in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[bucket], cuts[bucket + 1])
                # The first gram of a bucket stands by itself.
                from_first = np.concatenate((grams[part][:1], steps[part][1:]))
                number = docs.column("batch")[0].as_py()
                rows.append((number, int(bucket), packed(from_first), packed(good[part]), packed(every[part])))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array([r[i] for r in rows], kinds[i]) for i, k in enumerate(names)})

    return (
        dealt.groupBy("batch")
        .cogroup(target.groupBy("batch"))
        .applyInArrow(counted, "batch long, bucket int, grams binary, target binary, background binary")
    )


def summed_grams(counted: DataFrame) -> DataFrame:
    """(batch, bucket, target, background): for each batch's grams the counts of all batches."""

    def summed(group: pa.Table) -> pa.Table:
        own = [np.cumsum(unpacked(b), dtype=np.uint64) for b in group.column("grams").to_pylist()]
        grams, at = np.unique(np.concatenate(own), return_inverse=True)
        ends = np.cumsum([x.size for x in own])
        out = {"batch": group.column("batch"), "bucket": group.column("bucket")}
        for name in ("target", "background"):
            counts = np.concatenate([unpacked(b) for b in group.column(name).to_pylist()])
            sums = np.zeros(grams.size, dtype=np.uint64)
            np.add.at(sums, at, counts)
            out[name] = pa.array([packed(x) for x in np.split(sums[at], ends[:-1])], pa.binary())
        return pa.table(out)

    return counted.groupBy("bucket").applyInArrow(summed, "batch long, bucket int, target binary, background binary")


def _losses(grams: np.ndarray, target: np.ndarray, background: np.ndarray, size: int) -> np.ndarray:
    """What one occurrence of each gram adds to target loss minus background loss.

    P(word | word before) = (count of the pair + prior / vocabulary) / (count of the word before +
    prior), so a loss is a sum of a pair's part and its first word's part.
    """
    pairs = (grams & np.uint64(1)) == 1
    more = np.where(pairs, WORD_PRIOR / size, WORD_PRIOR)
    apart = np.log(background + more) - np.log(target + more)
    return np.where(pairs, apart, -apart)


def score_documents(
    docs: DataFrame,
    target_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH,
) -> DataFrame:
    """(doc_id, n_tokens, score): mean over a text's tokens of target loss minus background loss.

    Tokens are a text's words and its end. Low scores are like the target. `target_ids` has one
    column, the ids of the target documents; repeated and null ids in it add nothing. Background
    are all documents, repeated rows each for itself. A text without a word, a null or empty one
    too, has no tokens and a null score. With no target text all target losses are those of an even
    distribution. An empty table gives no rows. Ids keep their type. Grams are named by 56-bit
    hashes. Rows of one id come to one batch.
    """
    own = texts_of(docs, id_col, text_col)
    total = own.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n or 0
    batches = max(1, -(-total // batch_bytes))
    buckets = 1 << (batches - 1).bit_length()
    size = vocabulary_size(own)

    def batch(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(batches)).cast("long").alias("batch")

    place = F.when(F.col("doc_id").isNotNull(), batch(F.col("doc_id"))).otherwise(batch(F.col("text")))
    dealt = own.select(place.alias("batch"), "doc_id", "text")
    chosen = target_ids.select(F.col(f"`{target_ids.columns[0]}`").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    kind = own.schema["doc_id"].dataType
    chosen = chosen.select(F.col("doc_id").cast(kind).alias("doc_id"))
    target = chosen.select(batch(F.col("doc_id")), "doc_id")
    counts = summed_grams(counted_grams(dealt, target, buckets))

    def scored(docs: pa.Table, answers: pa.Table) -> pa.Table:
        text, own_grams, tokens = _grams(_texts(docs))
        scores = np.zeros(tokens.size)
        if own_grams.size:
            grams, at = np.unique(own_grams, return_inverse=True)
            order = np.argsort(answers.column("bucket").to_numpy())
            good, every = (
                np.concatenate([unpacked(answers.column(c)[int(i)].as_py()) for i in order]).astype(np.float64)
                for c in ("target", "background")
            )
            losses = _losses(grams, good, every, size)
            scores = np.bincount(text, weights=losses[at], minlength=tokens.size) / np.maximum(tokens, 1)
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_tokens": pa.array(tokens), "score": pa.array(scores, mask=tokens == 0),
        })

    return (
        dealt.groupBy("batch")
        .cogroup(counts.groupBy("batch"))
        .applyInArrow(scored, f"doc_id {kind.simpleString()}, n_tokens long, score double")
    )


def good_documents(labels: DataFrame) -> Column:
    """Which labelled rows make up the target: good and not toxic."""
    return (F.col("quality") == 1) & (F.col("toxic") == 0)
