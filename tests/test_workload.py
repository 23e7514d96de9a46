"""Named workload behaviours on tiny event logs."""

from __future__ import annotations

import pytest

from fleetlens.operators import workload

SCHEMA = (
    "app_id string, run_id string, node_id string, phase string, sequence bigint, duration_us bigint, "
    "query_id string, statement_class string, rowcount bigint, transaction_id string, "
    "bind_signature array<string>, call_sites array<struct<path:string,line:bigint,symbol:string>>, "
    "relations array<string>, normalized_sql string, parse_error string"
)


def event(sequence, query, kind="read", rowcount=None, binds=(), sites=(), relations=("public.t",), tx=None, us=5, node="n"):
    return (
        "a", "r", node, "call", sequence, us, query, kind, rowcount, tx, list(binds), list(sites), list(relations), query, None,
    )


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.parent_query, r.child_query, r.repetitions, r.classification) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_observed_n_plus_one(frame, width):
    rows = [event(1, "parent", rowcount=5)] + [event(2 + i, "child", binds=[str(i)]) for i in range(5)]
    got = found(workload.detect_amplification(frame(rows), width=width))
    assert got == {("parent", "child", 5, "observed_n_plus_one")}


def test_same_binds_are_plain_repetition_even_without_binds(frame):
    rows = [event(1, "parent", rowcount=5)] + [event(2 + i, "child") for i in range(5)]
    assert found(workload.detect_amplification(frame(rows))) == {("parent", "child", 5, "repeated_query")}


def test_null_binds_count_as_values(frame):
    rows = [event(1, "p", rowcount=9)] + [event(2 + i, "c", binds=[None if i else "x"]) for i in range(5)]
    assert found(workload.detect_amplification(frame(rows))) == {("p", "c", 5, "possible_amplification")}


def test_position_of_a_null_bind_counts(frame):
    rows = [event(1, "p", rowcount=9)]
    rows += [event(2 + i, "c", binds=["x", None] if i % 2 else [None, "x"]) for i in range(5)]
    assert found(workload.detect_amplification(frame(rows))) == {("p", "c", 5, "possible_amplification")}


def test_unknown_parent_rowcount_never_matches(frame):
    rows = [event(1, "p")] + [event(2 + i, "c", binds=[str(i)]) for i in range(5)]
    assert found(workload.detect_amplification(frame(rows))) == {("p", "c", 5, "possible_amplification")}


def test_write_parent_is_only_possible(frame):
    rows = [event(1, "p", kind="write", rowcount=5)] + [event(2 + i, "c", binds=[str(i)]) for i in range(5)]
    assert found(workload.detect_amplification(frame(rows))) == {("p", "c", 5, "possible_amplification")}


def test_no_parent_or_too_few_gives_nothing(frame):
    first = [event(1 + i, "c", binds=[str(i)]) for i in range(6)]
    few = [event(20, "p", rowcount=4)] + [event(21 + i, "d", binds=[str(i)]) for i in range(4)]
    other = [event(50 + i, "c", node="m", binds=[str(i)]) for i in range(6)]
    assert found(workload.detect_amplification(frame(first + few + other))) == set()


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_parent_is_the_nearest_earlier_query(frame, width):
    rows = [event(1, "far", rowcount=5), event(2, "near", rowcount=5)]
    rows += [event(10 + i, "c", binds=[str(i)]) for i in range(5)]
    assert found(workload.detect_amplification(frame(rows), width=width)) == {
        ("near", "c", 5, "observed_n_plus_one")
    }


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_equal_sequence_numbers_go_by_arrival(frame, width):
    numbers = [(2, "parent"), (2, "child"), (3, "child"), (3, "child"), (4, "child"), (4, "child")]
    rows = [event(1, "other", rowcount=1)]
    rows += [
        event(n, q, rowcount=5, binds=[str(i)], sites=[(f"app/{i}.py", 1, "f")]) for i, (n, q) in enumerate(numbers)
    ]
    # The site tells the place in the log.
    place = "coalesce(cast(regexp_extract(get(call_sites, 0).path, '[0-9]+', 0) as int), -1)"
    log = frame(rows).selectExpr("*", f"{place} as arrival")
    hits = workload.detect_amplification(log, width=width)
    assert found(hits) == {("parent", "child", 5, "observed_n_plus_one")}
    assert [r.call_site.path for r in workload.amplification_call_sites(hits, log).collect()] == ["app/1.py"]
    catalog = {r.query_id: [s.path for s in r.call_sites] for r in workload.query_catalog(log, log.dropDuplicates(["query_id"])).collect()}
    assert catalog["child"] == [f"app/{i}.py" for i in range(1, 6)]


def test_equal_sequence_numbers_without_arrival_give_one_row(frame):
    rows = [event(2, "a", rowcount=5)] + [event(2, "b", binds=[str(i)]) for i in range(5)]
    assert found(workload.detect_amplification(frame(rows))) == {("a", "b", 5, "observed_n_plus_one")}


def test_relationship_needs_one_key_between_single_relations(spark, frame):
    rows = [event(1, "p", rowcount=5, relations=["public.o"])]
    rows += [event(2 + i, "c", binds=[str(i)], relations=["public.i"]) for i in range(5)]
    log = frame(rows)
    hits = workload.detect_amplification(log)
    queries = log.select("query_id", "relations").distinct()
    schema = "name string, table_id string, referenced_table string"
    one = spark.createDataFrame([("fk", "public.i", "public.o")], schema)
    two = spark.createDataFrame([("fk", "public.i", "public.o"), ("fk2", "public.i", "public.o")], schema)
    assert workload.name_relationships(hits, queries, one).first().relationship_name == "fk"
    assert workload.name_relationships(hits, queries, two).first().relationship_name is None


def test_operation_rollup(frame):
    site = ("app/a.py", 3, "f")
    rows = [
        event(2, "q", relations=["public.b", "public.a"], us=0, sites=[("app/b.py", 9, "g")]),
        event(1, "w", kind="write", relations=["public.c"], us=0),
        event(3, "z", kind="schema", relations=["public.d"], us=0, sites=[site]),
    ]
    log = frame(rows)
    got = workload.operation_rollup(log, log).first()
    assert got.tables_read == ["public.a", "public.b"]
    assert got.tables_written == ["public.c"]
    assert got.observed_duration_us is None
    assert got.entry_point.path == "app/b.py"
    assert got.query_count == 3


def test_call_sites_merge_in_first_seen_order(frame):
    a, b = ("app/a.py", 1, "f"), ("app/b.py", 2, "g")
    rows = [event(3, "q", sites=[a, b]), event(1, "q", sites=[b]), event(2, "q")]
    log = frame(rows)
    got = workload.query_catalog(log, log.dropDuplicates(["query_id"])).first()
    assert [s.path for s in got.call_sites] == ["app/b.py", "app/a.py"]
    assert got.executions == 3


@pytest.mark.parametrize("width", [1, 100])
def test_transactions_keep_order_and_default_to_not_committed(spark, frame, width):
    rows = [event(5, "b", tx="t1"), event(2, "a", tx="t1"), event(3, "x"), event(4, "c", tx="t2")]
    outcomes = spark.createDataFrame([("a", "r", "t1", True)], "app_id string, run_id string, transaction_id string, committed boolean")
    got = workload.transaction_rollup(frame(rows), outcomes, width).collect()
    assert {(r.transaction_id, r.position, r.query_id, r.committed) for r in got} == {
        ("t1", 1, "a", True), ("t1", 2, "b", True), ("t2", 1, "c", False),
    }
