from __future__ import annotations

import re
from pathlib import Path

from fleetlens.llm import licenses

SCHEMA = "doc_id long, path string, text string"


def test_full_texts_speak_for_their_folders(spark):
    names = list(licenses.FULL_TEXTS)
    files = [re.sub(r"\[?copyright holders?\]?", f"Zedd {i} Wuppertal", t) for i, t in enumerate(licenses.FULL_TEXTS.values())]
    rows = [(i, f"p{i}/LICENSE", f"Project Quux\n\n{t}") for i, t in enumerate(files)]
    rows += [(100 + i, f"p{i}/src/deep/one.txt", "plain prose of the place") for i in range(len(files))]
    rows += [(1000 + i, f"z/{i}.txt", f"the words of a common text number {i}") for i in range(500)]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), "path").collect()}
    for i, name in enumerate(names):
        assert (got[i].license, got[i].origin) == (name, "file") and got[i].similarity > 0.85
        assert (got[100 + i].license, got[100 + i].origin, got[100 + i].folder) == (name, "inherited", f"p{i}")
    assert all(got[1000 + i].license is None for i in range(500))


def test_a_full_text_is_no_notice(spark):
    """A long document with the text's opening in it is not a license file."""
    body = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, "a/x", f"{body}\n\n{licenses.FULL_TEXTS['MIT']}"), (2, "a/y", "prose")]
    got = {r.doc_id: r for r in licenses.scan_documents(spark.createDataFrame(rows, SCHEMA), "path").collect()}
    assert (got[1].license, got[1].origin, got[2].license) == ("MIT", "header", None)


def test_texts_lie_beside_the_code():
    folder = Path(licenses.__file__).parent / "license_texts"
    assert {f.stem for f in folder.glob("*.txt")} == set(licenses.FULL_TEXTS)
