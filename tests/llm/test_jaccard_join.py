from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import jaccard_join, queries

SCHEMA = "doc_id long, text string, k1 string, component int"


def shingles(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, similarity=0.8):
    """(doc_id, class_id, n_links) of each row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    having = {}
    for i, s in enumerate(sets):
        for g in s:
            having.setdefault(g, []).append(i)
    links, label = [set() for _ in rows], list(range(len(rows)))
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in having[g] if j > i).items():
            if n >= similarity * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    moved = True
    while moved:
        moved = False
        for i, near in enumerate(links):
            for j in near:
                if label[j] < label[i]:
                    label[i], moved = label[j], True
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[label[i]] = min(key, least.get(label[i], key))
    return Counter((key, least.get(label[i]), len(links[i])) for i, (key, _) in enumerate(rows))


def near_copies(rnd, n, words=60, changes=2):
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rnd.randrange(changes + 1)):
            text[rnd.randrange(words)] = f"x{rnd.randrange(500)}"
        yield " ".join(text)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    texts = [None, "", " \t\n", "one", "one", "one two", "a b c d e", "a b c d  e", "a b c d e f"]
    for n in (2, 3, 9, 40):
        texts += near_copies(rnd, n)
    texts += [t for t in texts[20:26] for _ in range(3)]
    texts += [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(80))) for _ in range(60)]
    out = list(enumerate(texts)) + [(None, "one"), (3, "one"), (3, "one"), (None, None)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("block", [128, 7])
def test_classes_and_links(spark, rows, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_one_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = [(i, t) for i, t in rows if (t or "").split()]
    want = Counter(c for _, c, _ in set(brute(texts)))
    got = Counter(r.doc_id for r in kept.collect() if (r.text or "").split())
    assert set(got) == set(want) and max(got.values()) == 1
    assert sum(not (r.text or "").split() for r in kept.collect()) == sum(not (t or "").split() for _, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard_join.near_duplicates(docs).collect() == []
    assert jaccard_join.one_of_each(docs).collect() == []


def test_depth_reaches_the_recall():
    depth = jaccard_join.prefix_depth(0.8, 32, 8, 0.9999)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 32
    assert jaccard_join.prefix_depth(0.8, 2, 8, 0.9999) == 1


def test_signatures_agree_as_often_as_sets_do():
    rnd = random.Random(1)
    one = [f"w{i}" for i in range(300)]
    two = list(one)
    for _ in range(6):
        two[rnd.randrange(300)] = "new"
    a, b = shingles(" ".join(one)), shingles(" ".join(two))
    found = [p for _, p in jaccard_join.prefixes([" ".join(one).encode(), " ".join(two).encode()], 5, 2000, 1)]
    agree = np.mean([p[0] == p[1] for p in found])
    assert abs(agree - len(a & b) / len(a | b)) < 0.05


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = Counter(tuple(r) for r in queries.op9(spark, sf_dir).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs])


@pytest.mark.parametrize("ids", [(None, None, None, None), (1, 2, 1, 2)])
def test_classes_of_equal_ids_stay_apart(spark, ids):
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    texts = [one, one + " end", two, two + " end"]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    kept = [r.text[0] for r in jaccard_join.one_of_each(docs).collect()]
    assert sorted(kept) == ["a", "b"]
