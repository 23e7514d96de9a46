from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

from fleetlens.llm import queries, sharding

SCHEMA = "doc_id long, text string, row string, size int"


def check(rows, texts, shards):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_permutation_and_way_back():
    for n in (1, 2, 3, 7, 10, 997, 1000, 65537):
        places = sharding.permute(np.arange(n), n, 5)
        assert sorted(places) == list(range(n))
        assert (sharding.permute(places, n, 5, inverse=True) == np.arange(n)).all()
    assert (sharding.permute(np.arange(997), 997, 5) != sharding.permute(np.arange(997), 997, 6)).any()


def test_shard_and_slot_are_computable(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "x", 1) for i in range(50)], SCHEMA)
    for r in sharding.shard_documents(docs, 7, 3).collect():
        assert sharding.locate(r.doc_id, 50, 7, 3) == (r.shard, r.slot)
        assert sharding.row_at(r.shard, r.slot, 50, 7, 3) == r.doc_id


def test_layout_has_no_part_in_the_result(spark):
    texts = [(i, f"text {i % 7}") for i in range(200)] + [(None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], SCHEMA)
    one = sharding.shard_documents(docs.repartition(1), 5).collect()
    two = sharding.shard_documents(docs.repartition(9), 5).collect()
    check(one, texts, 5)
    assert Counter(one) == Counter(two)


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(queries.op7(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs], 24)
