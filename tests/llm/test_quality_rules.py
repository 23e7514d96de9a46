from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import quality_rules, queries

SCHEMA = "doc_id long, text string, n_words string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    again = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def sentence(rnd, n, junk=False):
    return " ".join(rnd.choice("abcdef") * rnd.randrange(1, 9) + ("#*" if junk else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\t ", "a", "a b c d e a b c d e", "x " * 40, "é 😀\x0bß\x0c\x85 z y", "l\nl\n\nl \nl\r\n"]
    out += [sentence(rnd, 60, i % 2 == 0) for i in range(120)]
    return out + out[20:25]


def test_statistics(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.judge_documents(docs, labels).collect():
        assert tuple(r)[1:7] == brute(texts[r.doc_id])
        assert r.kept == (not r.base_failed)


def test_learned_rules_reject_and_take_effect(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    given = [(i, 0 if i % 2 == 0 else 1, 0) for i in range(8, 128)] + [(None, 0, 0), (9, None, 0), (5000, 1, 0)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and rules == quality_rules.learn_rules(docs.repartition(5), labels.repartition(3))
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs, labels).collect()}
    assert all(got[i].kept == (i % 2 == 1 and not got[i].base_failed) for i in range(8, 128))
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_no_python_in_the_plan(spark, texts):
    docs = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    plan = quality_rules.judged(docs.select("doc_id", "text"), [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge_documents(docs, labels).collect() == []


def test_covering_finds_a_conjunction():
    rnd = np.random.Generator(np.random.PCG64(1))
    values = {"words": rnd.random(3000), "word_length": rnd.random(3000), "symbol_share": rnd.random(3000)}
    bad = (values["words"] > 0.7) & (values["symbol_share"] < 0.4)
    rules = quality_rules.learn(values, bad)
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        assert 1 <= len(rule) <= quality_rules.CONDITIONS
        hit |= quality_rules._covered(rule, values, np.ones(3000, dtype=bool))
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.05 * bad.sum()


def test_one_kind_of_label_teaches_nothing():
    assert quality_rules.learn({"words": np.arange(10.0)}, np.zeros(10, dtype=bool)) == []
    assert quality_rules.learn({"words": np.arange(0.0)}, np.zeros(0, dtype=bool)) == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4(spark, sf_dir).collect()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == {k: brute(t) for k, t in docs.items()}


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    good = [got[r.doc_id] for r in held if r.quality == 1]
    bad = [got[r.doc_id] for r in held if r.quality == 0]
    assert sum(not r.kept and not r.base_failed for r in good) <= 0.02 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)
