"""The pipeline beside plain versions of its stages, and the driver's contract about it."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute as classes
from test_packing import PATH, check, reference  # noqa: F401
from test_suffix_dedup import brute as repeats

import __spark_entry__ as entry
from fleetlens.llm import packing, pii, quality_rules, queries
from fleetlens.sources.scratch import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The table before each stage and after the last."""
    tables = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], sf_dir), name))
    return tables


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for table in stages[1:-1]:
        assert table.dtypes == stages[0].dtypes


def test_quality_keeps_what_its_query_keeps(spark, sf_dir, stages):
    kept = {r.doc_id for r in queries.op4(spark, sf_dir).collect() if r.kept}
    before = {r.doc_id: r for r in stages[0].collect()}
    assert {r.doc_id: r for r in stages[1].collect()} == {i: before[i] for i in kept}
    assert 0.5 * len(before) < len(kept) < len(before)


def test_one_document_of_each_class_stays(stages):
    before = {r.doc_id: r for r in stages[1].collect()}
    least = {c for _, c, _ in classes([(r.doc_id, r.text) for r in before.values()])}
    assert {r.doc_id: r for r in stages[2].collect()} == {i: before[i] for i in least}


def test_repeats_are_cut(stages):
    before = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in stages[3].collect()}
    assert set(after) == {r.doc_id for r in before}
    for r, (n_bytes, n_removed, n_spans, _) in zip(before, repeats([r.text for r in before], 200), strict=True):
        left = len(after[r.doc_id].text.encode())
        assert n_bytes - n_removed <= left <= n_bytes - n_removed + 6 * n_spans
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        assert n_removed or after[r.doc_id] == r


def test_private_values_have_pseudonyms(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    back = pii.with_pseudonyms(stages[4].select("doc_id", "text"), queries.KEY, inverse=True)
    changed = 0
    for r in back.collect():
        assert r.text == before[r.doc_id].text
        changed += bool(r._kinds and any(r._kinds))
    assert changed and back.count() == len(before)


def test_packing_places_every_token(stages, reference):  # noqa: F811
    docs = {r.doc_id: r.text for r in stages[4].collect()}
    check(stages[5].collect(), docs, reference, packing.CAPACITY)


def test_empty_documents_pass_through(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_contract(spark, sf_dir):
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf_dir).select(F.count("*")).first()[0] > 0
    assert quality_rules.SAMPLE == 20_000
