from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import pii, queries

SCHEMA = "doc_id long, text string, _kinds string, _new int"
KEY = "k"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card(rnd, n=16):
    body = "".join(rnd.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    own = docs.select("doc_id", "text")
    return [r for r in pii.with_pseudonyms(own, KEY, **options).orderBy("doc_id").collect()]


VALUES = {
    "email": ["anna.b7@mail.example.com", "x@y.co", "vié.24@mail4.example.com"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"],
    "date": ["1999-12-31", "2024/02/29", "01.05.1987"],
    "ip": ["227.5.221.1", "0.0.0.0", "255.255.255.255"],
    "phone": ["+1 (743) 555-3824", "+1(017)555.7713"],
    "ssn": ["123-45-6789", "667-01-0001"],
    "card": ["4417744280351547", "4417-7442-8035-1547", "4417 7442 8035 1547", "4222222222222"],
}
LEFT_ALONE = [
    "4417744280351548", "1999-02-30", "2150-01-01", "256.1.1.1", "1.2.3.4.5", "000-12-3456", "666-12-3456",
    "a" * 40, "0" * 40, "user@host", "555-3824", "x4417744280351547", "12345", "", " ", "no digits at all",
]


def test_formats_and_way_back(spark):
    texts = [f"({v}) and, {v}." for own in VALUES.values() for v in own]
    kinds = [kind for kind, own in VALUES.items() for _ in own]
    out = run(spark, texts)
    for r, text, kind in zip(out, texts, kinds, strict=True):
        value, new = text[1 : text.index(")", len(text) // 2 - 6) if kind != "phone" else 1 + (len(text) - 9) // 2], None
        value = text[1 : 1 + (len(text) - len("() and, .")) // 2]
        new = re.fullmatch(r"\((.*)\) and, (.*)\.", r.text)
        assert new[1] == new[2] != value and r._kinds == [kind, kind]
        if kind != "ip":
            assert re.sub(r"[^\W_]", "#", new[1]) == re.sub(r"[^\W_]", "#", value)
        if kind == "email":
            assert new[1].split("@")[1] == value.split("@")[1]
        if kind == "card":
            assert luhn(re.sub(r"\D", "", new[1]))
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in new[1].split("."))
        if kind == "date":
            y, m, d = map(int, re.findall(r"\d+", new[1])) if new[1][2] != "." else map(int, reversed(new[1].split(".")))
            assert datetime.date(1900, 1, 1) <= datetime.date(y, m, d) <= datetime.date(2099, 12, 31)
    assert [r.text for r in run(spark, [r.text for r in out], inverse=True)] == texts


def test_invalid_values_stay(spark):
    out = run(spark, [*LEFT_ALONE, None])
    assert [r.text for r in out] == [*LEFT_ALONE, None]
    assert not any(k for r in out for k in r._kinds or [])


def test_different_values_stay_different(spark):
    rnd = random.Random(3)
    cards = {card(rnd) for _ in range(300)}
    ips = {f"{a}.{b}.0.1" for a in range(20) for b in range(15)}
    days = {str(datetime.date(1900, 1, 1) + datetime.timedelta(d)) for d in range(0, 73049, 243)}
    out = run(spark, [" ".join(sorted(cards)), " ".join(sorted(ips)), " ".join(sorted(days))])
    assert [len(set(r.text.split())) for r in out] == [len(cards), len(ips), len(days)]


def test_small_permutation_is_one(spark):
    rows = spark.range(17 * 4297).select(
        pii.permuted_numbers([F.expr("id div 4297"), F.expr("id % 4297")], [17, 4297], KEY, "date").alias("p")
    )
    assert rows.distinct().count() == 17 * 4297


def test_all_columns_pass(spark):
    docs = spark.createDataFrame([(1, "at 227.5.221.1", "kinds", None)], SCHEMA)
    r = pii.private_documents(docs, KEY).collect()[0]
    assert r._kinds == "kinds" and r._new is None and r.text != "at 227.5.221.1" and r.text.startswith("at ")
    assert pii.pseudonymize_documents(docs.limit(0), KEY).collect() == []


def test_long_runs_are_looked_through_once(spark):
    texts = ["a1" * 200_000, "1." * 200_000, "f" * 300_000 + "1", "9" * 300_000, "x@" * 100_000]
    assert [len(r.text) for r in run(spark, texts)] == [len(t) for t in texts]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    plan = pii.pseudonymize_documents(docs, KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


#: The same formats once more, written for another engine of regular expressions.
FORMATS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "card": r"\b\d{16}\b",
}


@pytest.fixture(scope="module")
def result(spark, sf_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    return before, {r.doc_id: r for r in queries.op5(spark, sf_dir).collect()}


def test_query_replaces_valid_values_only(result):
    before, after = result
    assert set(before) == set(after)
    linked = {}
    for key, text in before.items():
        spans = []
        for kind, pattern in FORMATS.items():
            for m in re.finditer(pattern, text):
                if kind == "card" and not luhn(m[0]) or kind == "ip" and max(map(int, m[0].split("."))) > 255:
                    continue
                spans.append((m.start(), m.end(), kind, m[0]))
        r = after[key]
        assert [r[f"n_{kind}"] for kind in FORMATS] == [sum(s[2] == kind for s in spans) for kind in FORMATS]
        # What stands between values is untouched, and equal values have equal pseudonyms.
        rest, at = r.text, 0
        for first, end, kind, value in sorted(spans):
            between = text[at:first]
            assert rest.startswith(between)
            rest = rest[len(between) :]
            size = end - first if kind != "ip" else re.match(FORMATS["ip"], rest).end()
            new, rest = rest[:size], rest[size:]
            assert new != value and linked.setdefault((kind, value), new) == new
            at = end
        assert rest == text[at:]
    assert len(set(linked.values())) == len(linked) > 10
