from __future__ import annotations

import hashlib
import random

from fleetlens.llm import fingerprints, queries

SCHEMA = "doc_id long, text string, part string, print int"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(n))


def expected(rows):
    """Edited text of each row in the order given (descending id)."""
    texts = [t or "" for _, t in rows]
    return [fingerprints.edited(t, texts[(i + 1) % len(texts)]) for i, t in enumerate(texts)]


def check(got, rows):
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    alone = {key: fingerprints.sketches([(t or "").encode()])[0] for key, t in rows}
    for (key, text), changed, after in zip(rows, expected(rows), [*rows[1:], rows[0]], strict=True):
        r, own = by_id[key], alone[key]
        sketch = fingerprints.sketches([changed.encode()])[0]
        assert r.n_chars == len(text or "")
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == own.astype(">u4").tobytes().hex()
        assert r.edited_fingerprint == sketch.astype(">u4").tobytes().hex()
        assert r.near_edited == fingerprints.likeness(own, sketch)
        assert r.near_next == fingerprints.likeness(own, alone[after[0]])


def test_order_edits_and_neighbours(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, rnd.randrange(200))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "aaaaaaaaaaaaaa"), (73, "é"), (74, rows[5][1]), (-5, "negative one")]
    rows.sort(reverse=True)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(7)
    got = fingerprints.fingerprint_documents(docs).collect()
    check(got, rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[74].fingerprint == by_id[5].fingerprint


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "one", "x", 1)] * 2 + [(1, "two three", "x", 1)] * 3, SCHEMA)
    assert len(fingerprints.fingerprint_documents(docs).collect()) == 5


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "abcd", "x", 1)], SCHEMA)
    got = fingerprints.fingerprint_documents(docs).collect()
    assert [(r.n_chars, r.near_next) for r in got] == [(4, 1.0)]
    assert got[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprint_documents(docs.limit(0)).collect() == []


def test_inside_of_equal_substrings_is_named_alike():
    rnd = random.Random(5)
    middle = words(rnd, 400).encode()
    one, two = fingerprints.sketches([b"zz " + middle, words(rnd, 7).encode() + middle + b" tail"])
    other = fingerprints.sketches([words(rnd, 400).encode()])[0]
    assert fingerprints.likeness(one, two) > 0.9 > 0.1 > fingerprints.likeness(one, other)


def test_neighbours_in_a_batch_have_no_part():
    rnd = random.Random(6)
    texts = [words(rnd, rnd.randrange(50)).encode() for _ in range(80)]
    together = fingerprints.sketches(texts)
    assert all((fingerprints.sketches([t])[0] == s).all() for t, s in zip(texts, together, strict=True))


def test_query(spark, sf_dir):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    check(queries.op8(spark, sf_dir).collect(), rows)
