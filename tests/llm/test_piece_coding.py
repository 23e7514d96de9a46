from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fleetlens.llm import piece_coding, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, doc string, ids int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rnd = random.Random(7)
    words = "the of international über 12345 naïve  𓀀 日本語 \n\n\t {}; return==x".split(" ")
    out = [None, "", " ", "  two  blanks ", "a", "\n", "▁", "𓀀" * 50, "日本語テキスト" * 30, "x" * 300, " " * 300]
    out += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(200))) for _ in range(20)]
    out += ["".join(rnd.choice(words) for _ in range(rnd.randrange(200))) for _ in range(20)]
    out += ["".join(rnd.choice("abcdeé019_𓀀") for _ in range(rnd.randrange(500))) for _ in range(20)]
    return [*out, out[-1]]


@pytest.mark.parametrize("chunk", [40, 97, 10_000])
def test_chunks_give_the_ids_of_the_whole_text(spark, library, chunk):
    given = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(given)], SCHEMA).repartition(3)
    got = {r.doc_id: r.ids for r in piece_coding.encode_documents(docs, PATH, chunk).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        assert got[i] == library.encode(text or ""), text


def test_cuts_without_blanks_have_several_states(library):
    with open(PATH, "rb") as file:
        coder = piece_coding.Coder(file.read())
    assert coder.states("abc", " def") == [piece_coding.FREE]
    assert len(coder.states("internat", "ional")) > 3
    assert coder.states("𓀀", "𓀀") == [(1, 0)]


def test_product_is_associative_and_path_is_best():
    rnd = np.random.Generator(np.random.PCG64(3))
    one, two, three = (np.where(rnd.random((3, 3)) < 0.5, 0.0, -np.inf) for _ in range(3))
    left = piece_coding.product(piece_coding.product(one, two), three)
    assert (left == piece_coding.product(one, piece_coding.product(two, three))).all()
    ends = np.zeros((1, 3)), np.zeros((3, 1))
    middle = np.full((3, 3), -np.inf)
    middle[2, 1] = 0
    assert piece_coding.path([ends[0], middle, ends[1]]) == [2, 1, 0]


def test_decoding_is_the_way_back(spark):
    given = [t for t in texts() if t is not None and "▁" not in t]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(given)], SCHEMA)
    encoded = piece_coding.encode_documents(docs, PATH, 60)
    assert {r.doc_id: r.text for r in piece_coding.decode_documents(encoded, PATH).collect()} == dict(enumerate(given))


def test_empty_table_and_null_ids(spark):
    assert piece_coding.coded_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
    rows = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert tuple(piece_coding.decode_documents(rows, PATH).collect()[0]) == (1, 0, 0, "")


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6(spark, sf_dir).collect()}
    for key, text in docs.items():
        ids = np.array(library.encode(text), dtype="<u4")
        assert got[key] == (ids.size, zlib.crc32(ids.tobytes()), hashlib.sha256(text.encode()).hexdigest())
