from __future__ import annotations

import re

from fleetlens.llm import pii

KEY = "k"
VALUES = {
    "phone": [
        "555-123-4567", "(555) 123-4567", "+1 555 123 4567", "+44 20 7946 0958", "1-555-123-4567", "555.123.4567",
        "+442079460958", "+49 (30) 1234-5678", "+1-743-555-3824",
    ],
    "date": ["2024-05-06"],
    "card": ["3782 822463 10005", "3782-822463-10005", "378282246310005"],
}
CASES = [(kind, v) for kind, own in VALUES.items() for v in own]
LEFT = ["555-3824", "155-123-4567", "+12345", "3782 822463 10006", "2024-02-30T10:00", "12-555-123-4567", "2024-05-06x"]


def run(spark, texts, inverse=False):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pii.with_pseudonyms(docs, KEY, inverse=inverse).orderBy("doc_id").collect()


def test_widened_formats(spark):
    shapes = ["call {} now", "({})", "{}", "a: {}, b."]
    texts = [shape.format(v + "T10:00" * (kind == "date")) for shape in shapes for kind, v in CASES]
    out = run(spark, texts)
    for (kind, value), text, r in zip(CASES * len(shapes), texts, out, strict=True):
        assert r["_kinds"] == [kind], (value, r)
        assert value not in r.text and re.sub("[0-9]", "0", r.text) == re.sub("[0-9]", "0", text)
    assert [r.text for r in run(spark, [r.text for r in out], inverse=True)] == texts


def test_equal_numbers_have_equal_pseudonyms(spark):
    one, two = run(spark, ["(+44 20 7946 0958)", "+44 20 7946 0958 x"])
    assert one.text.strip("()") == two.text[:-2]


def test_what_is_no_value_stays(spark):
    assert [r.text for r in run(spark, LEFT)] == LEFT


def _pseudonyms(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymize_documents(docs, "k").collect()}


def test_addresses_of_very_many_labels(spark):
    texts = ["x@" + "a." * n + "com" for n in (1, 120, 2000, 200_000)] + ["x@" + "com." * 200_000 + "com", "a@b.com.1 c@d.org.x2"]
    got = _pseudonyms(spark, texts)
    assert [got[i].n_email for i in range(6)] == [1, 1, 0, 0, 1, 2]
    assert got[2].text == texts[2] and got[0].text[0] != "x" and got[0].text[1:] == texts[0][1:]


def test_no_letter_of_a_local_part_stays_by_rule(spark):
    locals_ = ["李明", "jürgen", "иван", "αθηνά", "ju\u0308rgen", "𠮷野", "ñandú", "김철수", "משה", "Zoë.Å"]
    got = _pseudonyms(spark, [f"see {x}@example.com now" for x in locals_])
    for i, name in enumerate(locals_):
        new = got[i].text.removeprefix("see ").removesuffix("@example.com now")
        assert got[i].n_email == 1 and len(new) == len(name) and new != name
        same = [a for a, b in zip(name, new) if a == b and a.isalpha()]
        assert len(same) <= 1
    docs = spark.createDataFrame([(0, "李明@example.com jürgen@example.com иван@x.org")], "doc_id long, text string")
    there = pii.with_pseudonyms(docs, "k").drop("_kinds")
    back = pii.with_pseudonyms(there, "k", inverse=True).first().text
    assert there.first().text != back == "李明@example.com jürgen@example.com иван@x.org"
