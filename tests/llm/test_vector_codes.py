from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code int, entry int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Everything by plain Python numbers: a dictionary of lists, since ids may repeat."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    cut = [[r[1][p * d : p * d + d] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            own = []
            for p in range(parts):
                own.append(min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])))
            out.append(own)
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in a) for a in assign()]
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    codes = ["".join(f"{i:02x}" for _, i in a) for a in assign()]
    return sorted(((r[0], c, e, sums[r[2]], digest) for r, c, e in zip(kept, codes, errors)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def test_beside_brute_force(spark):
    rnd = random.Random(12)
    rows = [(i * 3 % 101, [rnd.gauss(0, 0.1) for _ in range(32)], rnd.choice([1, 2, None])) for i in range(100)]
    whole = [round(rnd.gauss(0, 3)) / 256 for _ in range(32)]
    rows += [(200 + i, whole, 1) for i in range(30)] + [(5, whole, 7), (5, rows[9][1], 7), (None, whole, 3), rows[4]]
    odd = [None, [], [None] * 32, [0.0] * 31 + [None], [float("nan")] + [0.0] * 31, [0.0] * 31 + [float("inf")]]
    odd += [[-float("inf")] * 32, [0.5] * 31, [0.5] * 16, [0.25] * 64]
    rows += [(-1 - i, v, 1) for i, v in enumerate(odd[:8])] + [(900 + i, v, 1) for i, v in enumerate(odd)]
    got = found(vector_codes.compress_vectors(table(spark, rows).repartition(7)))
    assert got == brute(rows)
    assert len(got) == 134


def test_fewer_rows_than_entries_and_equal_vectors(spark):
    rows = [(i, [0.1] * 16, 0) for i in range(5)] + [(9, [-0.1] * 16, 0)]
    got = found(vector_codes.compress_vectors(table(spark, rows)))
    assert got == brute(rows)
    assert {r[1] for r in got if r[0] < 5} == {"00" * 16}


def test_no_usable_rows(spark):
    for rows in ([], [(1, None, 1), (2, [], 1), (3, [float("nan")] * 16, 1), (4, [1.0] * 15, 1)]):
        df = vector_codes.compress_vectors(table(spark, rows))
        assert df.collect() == []
        assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_huge_components_are_held(spark):
    rows = [(i, [3e38 * (-1) ** i] * 16, 1) for i in range(70)] + [(100, [0.0] * 16, 1)]
    got = found(vector_codes.compress_vectors(table(spark, rows)))
    assert len(got) == 71 and all(r[2] >= 0 for r in got)


def test_text_ids(spark):
    rows = [(f"v{i}", [0.01 * i] * 16, "a") for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    assert {r[0] for r in found(vector_codes.compress_vectors(df))} == {r[0] for r in rows}


@settings(max_examples=200, deadline=None)
@given(
    st.integers(1, 5).flatmap(
        lambda d: st.tuples(
            st.lists(st.lists(st.integers(-6, 6), min_size=d, max_size=d), min_size=1, max_size=20),
            st.lists(st.lists(st.integers(-6, 6), min_size=d, max_size=d), min_size=1, max_size=12),
        )
    )
)
def test_search_is_exact(case):
    vectors, entries = (np.array(x, dtype=np.int64) for x in case)
    index, distance = vector_codes.nearest(vectors, entries)
    want = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_search_looks_at_few_entries(monkeypatch):
    rnd = np.random.Generator(np.random.PCG64(1))
    vectors, entries = (rnd.normal(0, 32, (n, 4)).astype(np.int64) for n in (2000, 64))
    seen, plain = [], np.einsum

    def counted(text, a, b):
        seen.append(len(a))
        return plain(text, a, b)

    monkeypatch.setattr(vector_codes.np, "einsum", counted)
    vector_codes.nearest(vectors, entries)
    assert sum(seen) < 0.6 * vectors.shape[0] * entries.shape[0]


@pytest.mark.parametrize("bound", [vector_codes.farthest(64)])
def test_far_components_stay_in_64_bits(bound):
    far = np.full((1, 4), bound, dtype=np.int64)
    index, distance = vector_codes.nearest(far, np.concatenate((-far, far - 1)))
    assert index[0] == 1 and distance[0] == 4
    assert vector_codes.nearest(far, -far)[1][0] == 16 * bound * bound


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(queries.op12(spark, sf_dir)) == brute(rows)
