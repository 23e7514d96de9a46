from __future__ import annotations

import random
import re
from itertools import permutations

from fleetlens.llm import filter_audit, queries

SCHEMA = "doc_id long, text string, lang string, bits int, n string, part string, k1 string, `a.b` int"
LABELS = "doc_id long, quality int, toxic int, n int"


def brute(docs, labels):
    """(part, order, step) -> counts, by running every order over every document."""
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs),
        }
        good = any(i == doc_id and i is not None and q == 1 for i, q, _ in labels)
        toxic = any(i == doc_id and i is not None and t == 1 for i, _, t in labels)
        rows.append((lang or "", fails, good, toxic))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                earlier = sum(r[1][f] and any(r[1][g] for g in order[: step - 1]) for r in own)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                left = [r for r in left if not r[1][f]]
                lost = (sum(r[2] for r in gone), sum(r[3] for r in gone))
                out[part, "".join(order), step] = (len(left), len(gone), earlier, alone, *lost)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def frames(spark, docs, labels):
    wide = [(i, t, g, 3, "x", "y", "z", 4) for i, t, g in docs]
    return spark.createDataFrame(wide, SCHEMA), spark.createDataFrame([(*x, 1) for x in labels], LABELS)


def test_every_order_beside_brute_force(spark):
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ä", "B", "#", "é|"]
    texts = [None, "", " \t\x0b", "A B C", "# a", "ÄÖ", "a b\u0085c"]
    texts += [" ".join(rnd.choices(vocabulary[: rnd.choice([5, 304])], k=rnd.choice([3, 199, 200, 420]))) for _ in range(40)]
    texts += [t + " X" * 40 for t in texts[10:16] if t]
    docs = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts * 2)]
    docs += [(None, texts[12], "en"), (None, texts[12], "fr"), (5, "other", "en"), (5, texts[12], "en"), *docs[30:34]]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 90, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    assert found(filter_audit.audit_filters(*frames(spark, docs, labels))) == brute(docs, labels)


def test_bounds_of_the_filters(spark):
    words = " ".join(f"w{i}" for i in range(200))
    docs = [(1, words, "a"), (2, words[:-5], "a"), (3, "ab " * 200, "b"), (4, "A" * 3 + "b" * 97, "c"), (5, "A" * 4 + "b" * 96, "c")]
    assert found(filter_audit.audit_filters(*frames(spark, docs, []))) == brute(docs, [])


def test_many_copies_meet_one_row(spark):
    docs = [(i, "same words", "en") for i in range(3000)]
    got = found(filter_audit.audit_filters(*frames(spark, docs, [])))
    assert got["en", "EABCD", 1][:2] == (1, 2999)


def test_empty_tables(spark):
    assert filter_audit.audit_filters(*frames(spark, [], [])).collect() == []


def test_long_text(spark):
    docs = [(1, "w " * 500_000, "en"), (2, "x" * 2_000_000, "en")]
    assert found(filter_audit.audit_filters(*frames(spark, docs, []))) == brute(docs, [])


def test_query_and_its_sql(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = found(queries.op13(spark, sf_dir))
    assert got == brute(docs, labels)
