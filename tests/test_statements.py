"""Normal form, class, relations, parameter types and predicates of single statements."""

from __future__ import annotations

import pytest

from fleetlens.operators import statements


@pytest.fixture(scope="module")
def catalog(spark):
    columns = spark.createDataFrame(
        [
            ("public.orders", "id", "bigint", 1),
            ("public.orders", "status", "text", 2),
            ("public.orders", "total", "numeric(10,2)", 3),
            ("public.orders", "created_at", "timestamptz", 4),
            ("public.users", "id", "integer", 1),
            ("other.users", "name", "text", 1),
        ],
        "table_id string, name string, data_type string, ordinal int",
    )
    tables = spark.createDataFrame(
        [("public", "orders"), ("public", "users"), ("other", "users")], "schema_name string, name string"
    )
    return tables, columns


def described(spark, catalog, sql):
    df = spark.createDataFrame([(sql,)], "statement string")
    return statements.describe_statements(df, *catalog)


@pytest.mark.parametrize(
    ("sql", "normal", "kind"),
    [
        ("SELECT * FROM orders WHERE id = %s AND status = 'it''s'", "select * from orders where id = $1 and status = $2", "read"),
        ("select a from t where x like '%s%%' and y = %(limit)s", "select a from t where x like $2 and y = $1", "read"),
        ("INSERT INTO t VALUES (1, NULL, TRUE)", "insert into t values ( $1 , $2 , $3 )", "write"),
        ("SELECT 1 -- x = 'y'\n FROM t WHERE a IS NOT NULL", "select $1 from t where a is not null", "read"),
        ("WITH x AS (SELECT 1) DELETE FROM t USING x", "with x as ( select $1 ) delete from t using x", "write"),
        ('SELECT "Id", "name" FROM t;', 'select "Id" , name from t', "read"),
        ("CREATE INDEX i ON t (a)", "create index i on t ( a )", "schema"),
        ("BEGIN", "begin", "transaction"),
        ("SET x = 1", "set x = $1", "control"),
        ("CREATE VIEW v AS SELECT 1", "create view v as select $1", "unsupported"),
        ("SELECT 1; SELECT 2", "SELECT 1; SELECT 2", "unsupported"),
        ("SELEC 1", "SELEC 1", "unsupported"),
        ("", "<empty>", "unsupported"),
    ],
)
def test_normal_form_and_class(spark, sql, normal, kind):
    got = statements.normalize_statements(spark.createDataFrame([(sql,)], "statement string")).first()
    assert (got.normalized_sql, got.statement_class) == (normal, kind)


def test_values_do_not_change_the_id_but_casts_do(spark, catalog):
    def ids(*texts):
        df = spark.createDataFrame([(t,) for t in texts], "statement string")
        return [r.query_id for r in statements.describe_statements(df, *catalog).collect()]

    assert len(set(ids("select * from orders where id = 1", "SELECT  *  FROM orders WHERE id=22"))) == 1
    assert len(set(ids("select id::int from orders", "select id::bigint from orders"))) == 2


def test_long_literals_need_no_stack(spark):
    sql = "select * from t where a = '" + "x''" * 50_000 + "' and b in (" + ", ".join(["1"] * 5_000) + ")"
    got = statements.normalize_statements(spark.createDataFrame([(sql,)], "statement string")).first()
    assert got.normalized_sql.startswith("select * from t where a = $1 and b in ( $2 , $3")


def test_relations_and_types(spark, catalog):
    got = described(
        spark, catalog, "SELECT * FROM orders o, other.users u JOIN missing m ON true WHERE o.total > %s AND 5 = o.id AND zzz = 1"
    ).first()
    assert got.relations == ["other.users", "public.orders"]
    assert got.parameter_types == ["numeric(10,2)", "unknown", "bigint", "unknown"]


@pytest.mark.parametrize(
    ("where", "wanted"),
    [
        ("id = %s AND total >= 5", [("public.orders.id", "=", "equality"), ("public.orders.total", ">=", "numeric_range")]),
        ("created_at < %s", [("public.orders.created_at", "<", "timestamp_range")]),
        ("id = 1 OR status = 'x'", []),
        ("(id = 1 OR id = 2) AND status = 'x'", [("public.orders.status", "=", "equality")]),
        ("(id = 1 AND status = 'x')", [("public.orders.id", "=", "equality"), ("public.orders.status", "=", "equality")]),
        ("id IN (1, 2) AND status LIKE 'x' AND total BETWEEN 1 AND 2", []),
        ("status < 'x' AND id::int = 4", []),
        ("NOT (id = 1)", []),
    ],
)
def test_predicates(spark, catalog, where, wanted):
    queries = described(spark, catalog, f"SELECT * FROM orders WHERE {where} ORDER BY id LIMIT 3")
    got = statements.extract_predicates(queries, catalog[1]).orderBy("ordinal").collect()
    assert [(r.column_id, r.operator, r.kind) for r in got] == wanted
