from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.functions import minimizers
from fleetlens.operators import quality


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 299), st.integers(1, 120))
def test_a_part_shares_every_name_of_its_windows(data, at, length):
    part = data[at : at + length]
    if part:
        size = minimizers.size_for(len(part))
        assert set(minimizers.names_of(part, size)) <= set(minimizers.names_of(data, size))
        assert len(minimizers.names_of(part, size)) > 0


def test_long_windows_have_few_names():
    data = random.Random(1).randbytes(100_000)
    for size in (8, 16, 32, 64):
        assert len(minimizers.names_of(data, size)) < 5 * len(data) / size


def brute(texts, needles):
    pairs = {(n, i) for i, n in needles if n}
    return sorted((t, i) for t, text in texts for n, i in pairs if text is not None and n in text)


def scan(spark, texts, needles):
    text_frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "text_id int, text string, needle string, name int")
    needle_frame = spark.createDataFrame([(i, n, "x", 2) for i, n in needles], "needle_id string, needle string, text string, size int")
    return sorted(tuple(r) for r in quality.leak_scan(text_frame, needle_frame).collect())


def case(seed):
    rnd = random.Random(seed)
    letters = "ab é😀\n"
    texts = [(i, "".join(rnd.choices(letters, k=rnd.choice([0, 1, 7, 40, 400])))) for i in range(60)]
    whole = [t for _, t in texts if t]
    needles = []
    for k in range(80):
        text = rnd.choice(whole)
        at = rnd.randrange(len(text))
        needles.append((f"n{k % 70}", text[at : at + rnd.choice([1, 2, 3, 5, 8, 13, 40, 90, 400])]))
    needles += [("none", None), ("empty", ""), ("absent", "zz"), ("n1", needles[1][1])]
    return [*texts, (1000, None), (1001, "")], needles


@pytest.mark.parametrize("seed", range(2))
def test_scan_beside_plain_search(spark, seed):
    texts, needles = case(seed)
    assert scan(spark, texts, needles) == brute(texts, needles)


def test_texts_longer_than_a_slice():
    rnd = random.Random(3)
    text = rnd.randbytes(3 * minimizers.SLICE + 17)
    for size in minimizers.SIZES:
        places = [0, minimizers.SLICE - size // 2, minimizers.SLICE, 2 * minimizers.SLICE - 1, len(text) - size]
        names = np.array([minimizers.names_of(text[p : p + size], size)[0] for p in places])
        words = np.zeros(minimizers.BITS // 64, dtype=np.uint64)
        np.bitwise_or.at(words, minimizers.Sieve.word_of(names), np.uint64(1) << (names & np.uint64(63)))
        found = list(minimizers.names_in([b"", text[:5], text], [size], minimizers.Sieve(words)))
        own = np.concatenate([n[t == 2] for t, n in found])
        assert set(names) <= set(own)


def test_repeated_texts_and_no_needles(spark):
    texts = [(1, "a secret"), (1, "a secret"), (2, "secret")]
    assert scan(spark, texts, [("a", "secret")]) == [(1, "a"), (1, "a"), (2, "a")]
    assert scan(spark, texts, [("a", "")]) == scan(spark, [], [("a", "secret")]) == []


def test_few_names_meet_in_the_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS text_id", "text")
    needles = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").selectExpr(
        "cast(item_id AS string) AS needle_id", "text AS needle"
    )
    named = quality._needle_names(needles)
    sizes = [r["size"] for r in named.select("size").distinct().collect()]
    held = quality.window_names(docs, sizes, quality._sieve(named)).count()
    size = docs.selectExpr("sum(octet_length(text)) AS n").first().n
    assert held <= 0.05 * size
