from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from fleetlens.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, part int"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    coding = Tokenizer.from_file(PATH)
    return lambda text: coding.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, reference, capacity):
    """Every token of every document once, bytes equal, sequences gapless and within capacity."""
    ids = {key: np.array([*reference(text), 0], dtype="<u4") for key, text in docs.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert own.size == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
    assert set(by_doc) == set(docs)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
        assert sum(r.length for r in pieces) == ids[key].size
        assert len(pieces) == -(-ids[key].size // capacity)
        assert all(r.length == capacity for r in pieces[1:])
    for places in by_sequence.values():
        places.sort()
        ends = list(itertools.accumulate(length for _, length in places))
        assert [at for at, _ in places] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(by_sequence), sum(x.size for x in ids.values())


def test_small_table(spark, reference):
    rnd = random.Random(1)
    texts = [None, "", "a", "same text", "same text", "é😀 <|endoftext|>", "word " * 3000]
    texts += ["a <|endoftext|> b<|endoftext|>", "<|endoftext|>" * 70, "\u3000" * 30_000 + " x", " \n" * 9000]
    texts += [" ".join(rnd.choice("lorem ipsum dolor".split()) for _ in range(rnd.randrange(60))) for _ in range(90)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = packing.pack_documents(docs, PATH, capacity=64).collect()
    bins, tokens = check(rows, dict(enumerate(texts)), reference, 64)
    assert bins <= tokens / 64 + 2


def test_ids_on_demand(spark, reference):
    docs = spark.createDataFrame([(1, "one two three", "x", 1)], SCHEMA)
    row = packing.pack_documents(docs, PATH, with_ids=True).collect()[0]
    assert list(np.frombuffer(row.ids, dtype="<u4")) == [*reference("one two three"), 0]


def test_empty_table_and_null_id(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    docs = spark.createDataFrame([(None, "x", None, None)] * 3, SCHEMA)
    assert sorted(r.offset for r in packing.pack_documents(docs, PATH).collect()) == [0, 2, 4]


def test_fullest_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(300):
        items = [rnd.randrange(1, 30) for _ in range(rnd.randrange(9))]
        room = rnd.randrange(60)
        counts = {n: items.count(n) for n in items}
        sums = {sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k)}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(n) <= counts[n] for n in chosen)


def test_combinations_use_every_piece_once():
    rnd = random.Random(3)
    counts = {rnd.randrange(1, 2049): rnd.randrange(1, 50) for _ in range(300)}
    used = defaultdict(int)
    bins = packing.combinations(counts)
    for lengths, times in bins:
        assert sum(lengths) <= 2048
        for n in lengths:
            used[n] += times
    assert used == counts and len(bins) <= len(counts)


def test_query(spark, sf_dir, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bins, tokens = check(queries.op1(spark, sf_dir).collect(), docs, reference, 2048)
    assert bins <= tokens / 2048 * 1.05 + 1


def test_very_long_runs(spark, reference):
    texts = [" " * 2_000_000 + "x", "\n" * 1_200_000, "ab" * 200_000]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    rows = packing.pack_documents(docs, PATH).collect()
    check(rows, {f"d{i}": t for i, t in enumerate(texts)}, reference, packing.CAPACITY)
