from __future__ import annotations

import math
from collections import Counter

from fleetlens.llm import licenses, queries

SCHEMA = "doc_id long, path string, text string, folder string, license int"
GPL = "This work is licensed under the GNU General Public License, version 3."
APACHE = licenses.TEMPLATES["Apache-2.0"][1]

LONG = " ".join(f"word{i}" for i in range(60))


def cosine(one, two, idf):
    a, b = (Counter(licenses.WORDS.findall(t.lower())) for t in (one, two))
    dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
    norms = [math.sqrt(sum((n * idf(w)) ** 2 for w, n in c.items())) for c in (a, b)]
    return dot / math.prod(norms) if dot else 0.0


def segments(text):
    out, block = [], []
    for line in [*text.split("\n"), ""]:
        if licenses.WORDS.search(line.lower()):
            out.append(line)
            block.append(line)
        else:
            out.append("\n".join(block))
            block = []
    return out


def own(texts):
    """(license, cosine, origin) of each text, by all cosines of all segments."""
    known = set(licenses.VOCABULARY)
    frequency = Counter(w for t in texts for w in known & set(licenses.WORDS.findall((t or "").lower())))

    def idf(w):
        return math.log((1 + len(texts)) / (1 + frequency[w])) + 1

    def best(segment):
        found = [(cosine(segment, t, idf), name) for name, ts in licenses.TEMPLATES.items() for t in ts]
        return min(found, key=lambda f: (-f[0], f[1]))

    for text in texts:
        whole = best(text or "")
        part = min((best(s) for s in segments(text or "")), key=lambda f: (-f[0], f[1]), default=(0.0, ""))
        for found, origin in ((whole, "file"), (part, "header")):
            if found[0] >= licenses.SIMILARITY:
                yield found[1], round(found[0], 6), origin
                break
        else:
            yield None, None, None


ROWS = [
    ("a/LICENSE", APACHE), ("a/b/one.txt", "some words of prose"), ("a/b/two.txt", f"{LONG}\n{GPL}\nmore prose here"),
    ("a/b/c/LICENSE", "Released under the MIT License."), ("a/b/c/d/deep.txt", "prose once more"), ("other/x.txt", "prose"),
    ("root.txt", "prose without folder"), (None, "prose without a path"), ("a/b/null.txt", None), ("a/b/empty.txt", ""),
    ("a/multi.txt", "intro words\n\n" + APACHE.replace(". ", ".\n") + "\n\nvoid main body of words " * 30),
    ("a/b/c/NOTICE", "Licensed under CC BY 4.0."), ("a/b/one.txt", "some words of prose"),
]


def test_own_licenses_and_inheritance(spark):
    rows = [(i, p, t, "x", 1) for i, (p, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in licenses.scan_documents(docs, "path").collect()}
    want = list(own([t for _, t in ROWS]))
    for i, w in enumerate(want):
        if w[0]:
            assert (got[i].license, round(got[i].similarity, 6), got[i].origin) == w
    assert [w[2] for w in want] == ["file", None, "header", "file", None, None, None, None, None, None, "header", "file", None]
    inherited = {i: (r.license, r.folder) for i, r in got.items() if r.origin == "inherited"}
    near = max((got[i].similarity, got[i].license) for i in (3, 11))[1]
    assert inherited == {1: ("Apache-2.0", "a"), 8: ("Apache-2.0", "a"), 9: ("Apache-2.0", "a"), 12: ("Apache-2.0", "a"),
                         4: (near if got[3].similarity != got[11].similarity else "CC-BY-4.0", "a/b/c")}
    assert all(got[i].license is None for i in (5, 6, 7))


def test_root_folder_speaks_for_all(spark):
    rows = [(1, "LICENSE", GPL, "x", 1), (2, "a/b/c.txt", "prose", "x", 1), (3, "/abs/d.txt", "prose", "x", 1)]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    assert got[2].license == got[3].license == "GPL-3.0" and got[2].folder == ""


def test_empty_table(spark):
    assert licenses.scan_documents(spark.createDataFrame([], SCHEMA), "path").collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op10(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, own([r.text for r in docs]), strict=True):
        if w[0]:
            assert (got[r.doc_id].license, round(got[r.doc_id].similarity, 6), got[r.doc_id].origin) == w
        else:
            assert got[r.doc_id].origin in (None, "inherited")
    planted = [r for r in docs if GPL in r.text.split("\n")]
    assert all(got[r.doc_id].license == "GPL-3.0" for r in planted)
