from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import lm_scoring, queries
from fleetlens.llm.common import WORD

SCHEMA = "doc_id long, text string"


def model(texts, size):
    """Log probability of a word behind another, by plain counting."""
    pairs, before = Counter(), Counter()
    for t in texts:
        if own := re.findall(WORD, t or ""):
            pairs.update(zip([None, *own], [*own, None], strict=True))
            before.update([None, *own])
    a = lm_scoring.WORD_PRIOR
    return lambda v, w: math.log((pairs[v, w] + a / size) / (before[v] + a))


def brute(rows, target):
    size = len({w for _, t in rows for w in re.findall(WORD, t or "")}) + 1
    good, every = model([t for i, t in rows if i in target], size), model([t for _, t in rows], size)
    out = {}
    for i, t in rows:
        own = re.findall(WORD, t or "")
        losses = [every(v, w) - good(v, w) for v, w in zip([None, *own], [*own, None], strict=True)]
        out[i] = sum(losses) / len(losses) if own else None
    return out


def same(got, want):
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.score is None) == (w is None) and (w is None or abs(r.score - w) < 1e-9)


@pytest.mark.parametrize("batch", [200, 1500, 1 << 23])
def test_word_models(spark, monkeypatch, batch):
    monkeypatch.setattr(lm_scoring, "HELD", 8)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["river", "stone", "of", "the", "é", f"w{i}"]) for _ in range(rnd.randrange(1, 30)))) for i in range(50)]
    rows += [(90, None), (91, ""), (92, " \n\t"), (93, "one"), (94, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA + ", batch string, target int").repartition(3)
    target = {2, 3, 5, 8, 13, 93}
    ids = spark.createDataFrame([(i,) for i in [*target, 5, None, 999]], "id int")
    got = lm_scoring.score_documents(docs, ids, batch_bytes=batch).collect()
    same(got, brute(rows, target))
    assert {r.doc_id: r.n_tokens for r in got}[94] == len(rows[3][1].split()) + 1


def test_word_order_tells_texts_of_equal_words_apart(spark):
    rows = [(i, "red house near green river") for i in range(9)] + [(20, "river red near house green"), (21, "red house near green river")]
    ids = spark.createDataFrame([(i,) for i in range(9)], "id long")
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    assert got[21] < got[20]


def test_query(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    same(queries.op3(spark, sf_dir).collect(), brute(rows, target))


@pytest.mark.parametrize("ids", [[], [1]])
def test_no_target_and_no_rows(spark, ids):
    rows = [(1, "a b"), (2, "c d"), (1, "a b"), (None, "a"), (None, "b"), (2, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([(i,) for i in ids], "id long")
    got = lm_scoring.score_documents(docs, target).collect()
    wanted = [brute_row(rows, set(ids), k) for k in range(len(rows))]
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in got) == sorted(wanted)
    assert lm_scoring.score_documents(docs.limit(0), target).collect() == []


def brute_row(rows, target, k):
    size = len({w for _, t in rows for w in t.split()}) + 1
    good, every = model([t for i, t in rows if i in target], size), model([t for _, t in rows], size)
    own = rows[k][1].split()
    losses = [every(v, w) - good(v, w) for v, w in zip([None, *own], [*own, None], strict=True)]
    return str(rows[k][0]), len(losses), round(sum(losses) / len(losses), 9)


def test_packed_numbers_come_back():
    rnd = np.random.Generator(np.random.PCG64(1))
    for values in (np.zeros(3, np.uint64), np.array([7], np.uint64), rnd.integers(0, 2**56, 1000, dtype=np.uint64), np.array([256, 1], np.uint64)):
        assert (lm_scoring.unpacked(lm_scoring.packed(values)) == values).all()


def test_one_shuffle_of_the_texts(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('word ', id % 7, ' and ', id % 5) AS text")
    scored = lm_scoring.score_documents(docs, docs.select("doc_id").limit(20), batch_bytes=512)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_long_text_and_text_ids(spark):
    rows = [("a", "river stone " * 300_000), ("b", "x" * 1_000_000), ("c", "river stone")]
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([("c",)], "id string")).collect()}
    assert (got["a"].n_tokens, got["b"].n_tokens, got["c"].n_tokens) == (600_001, 2, 3)
    assert got["c"].score < got["b"].score
