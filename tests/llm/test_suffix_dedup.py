from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from fleetlens.llm import queries, suffix_dedup

SCHEMA = "doc_id long, text string, k1 int, spans string"


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rnd = random.Random(3)

    def letters(n):
        return "".join(rnd.choice("abcé ") for _ in range(n))

    passages = [letters(300) for _ in range(5)] + ["aaaa" * 120, "xyz" * 100]
    out = [None, "", "a" * 199, "a" * 200, "b" * 201, "c" * 500]
    for _ in range(60):
        text = letters(rnd.randrange(400))
        for _ in range(rnd.randrange(4)):
            first = rnd.randrange(60)
            part = (whole := rnd.choice(passages))[first : len(whole) - rnd.randrange(60)]
            if rnd.random() < 0.5:
                at = rnd.randrange(len(part))
                part = part[:at] + "Z" + part[at + 1 :]
            text += part + letters(rnd.randrange(50))
        out.append(text)
    return out + out[20:30]


@pytest.mark.parametrize("window,anchor", [(200, 50), (60, 20)])
def test_against_all_windows(spark, window, anchor):
    given = texts()
    docs = spark.createDataFrame([(i, t, i, "s") for i, t in enumerate(given)], SCHEMA).repartition(4)
    done = suffix_dedup.removed_spans(docs, window, anchor).select(
        "rest.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "rest.k1", "rest.spans"
    )
    got = {r.doc_id: tuple(r)[1:5] for r in done.collect()}
    assert got == dict(enumerate(brute(given, window)))


def test_kept_text_of_whole_characters(spark):
    middle = "é" * 120
    docs = spark.createDataFrame([(1, "AB" + middle + "CD", 1, "x"), (2, "x" + middle + "yz", 2, None)], SCHEMA)
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].text == "ABCD" and got[2].text == "xyz" and got[1].spans == "x" and got[2].spans is None


def test_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    given = [t for t in texts() if t]
    given.append("".join(given[10:30]))
    docs = spark.createDataFrame([(i, t, i, "s") for i, t in enumerate(given)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.dedup_documents(docs).collect()}
    assert got == dict(enumerate(brute(given, 200)))


def test_empty_table(spark):
    assert suffix_dedup.dedup_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: x for r, x in zip(docs, brute([r.text for r in docs], 200), strict=True)}
    assert {r.doc_id: tuple(r)[1:5] for r in queries.op2(spark, sf_dir).collect()} == want
