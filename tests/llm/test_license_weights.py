from __future__ import annotations

import math
from collections import Counter

import pytest

from fleetlens.llm import licenses

LINE = "Acme Tools: released under the MIT License."
COMMON = "acme tools"


def table(spark, n):
    """One in fifty documents has the line, every second one the words beside the license."""
    rows = [(i, f"d{i}/x", LINE if i % 50 == 0 else f"{COMMON} of prose" if i % 2 else "prose of things") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)


def cosine(line, template, texts):
    frequency = Counter(w for t in texts for w in set(licenses.WORDS.findall(t.lower())))
    a, b = (Counter(licenses.WORDS.findall(t.lower())) for t in (line, template))
    idf = {w: math.log((1 + len(texts)) / (1 + frequency[w])) + 1 for w in {*a, *b}}
    dot = sum(a[w] * b[w] * idf[w] ** 2 for w in a)
    return dot / math.sqrt(sum((n * idf[w]) ** 2 for w, n in a.items()) * sum((n * idf[w]) ** 2 for w, n in b.items()))


@pytest.mark.parametrize("n", [200, 20000])
def test_weights_of_all_words_are_counted(spark, n, monkeypatch):
    monkeypatch.setattr(licenses, "HELD", 5)
    rows, docs = table(spark, n)
    got = [r for r in licenses.scan_documents(docs, "path").where("doc_id % 50 = 0").collect()]
    want = max(cosine(LINE, t, [r[2] for r in rows]) for ts in licenses.TEMPLATES.values() for t in ts)
    assert len(got) == n // 50 and want >= licenses.SIMILARITY
    assert all(r.license == "MIT" and abs(r.similarity - want) < 1e-9 for r in got)
    assert want == pytest.approx(0.92, abs=0.06)


def test_rare_words_beside_a_license_outweigh_it(spark):
    rows = [(i, f"d{i}/x", "plain prose") for i in range(300)]
    rows += [(1000, "a/x", "Released under quite unheard whimsical zebra umbrella xylophone")]
    got = licenses.scan_documents(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path").where("doc_id = 1000").collect()
    assert got[0].license is None
