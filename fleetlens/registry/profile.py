"""Data profiling queries over orders, lineitem and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import profile
from fleetlens.operators.profile import Predicate
from fleetlens.registry.base import query
from fleetlens.registry.inputs import table

_EQUAL = {
    "orders": ["o_orderstatus", "o_orderpriority", "o_custkey"],
    "lineitem": ["l_returnflag", "l_linenumber", "l_orderkey"],
    "customer": ["c_mktsegment", "c_nationkey"],
}
_NUMERIC = [
    Predicate("lineitem", "l_quantity", 1, ">", "numeric_range"),
    Predicate("lineitem", "l_extendedprice", 2, "<=", "numeric_range"),
    Predicate("lineitem", "l_discount", 3, ">=", "numeric_range"),
    Predicate("lineitem", "l_tax", 4, "<", "numeric_range"),
]
_MOMENTS = [
    Predicate("orders", "o_orderdate", 1, ">", "timestamp_range"),
    Predicate("orders", "o_orderdate", 2, "<=", "timestamp_range"),
]


def _equality_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS table_id, '{column}' AS "column", m.method, m.value, m.n AS row_count FROM (
      WITH f AS (SELECT CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {name} WHERE {column} IS NOT NULL GROUP BY 1),
      s AS (SELECT count(*) AS d, list_sort(list(n))[count(*) // 2 + 1] AS med FROM f)
      SELECT * FROM (SELECT 'highly_selective' AS method, value, n FROM f ORDER BY n, value LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'moderate_selectivity', value, n FROM f, s ORDER BY abs(n - med), n, value LIMIT 1)
      UNION ALL SELECT * FROM (SELECT 'most_common_value', value, n FROM f ORDER BY n DESC, value LIMIT 1)
    ) m"""


def _numeric_sql(p: Predicate) -> str:
    up = p.operator in (">", ">=")
    tiers = (("highly_selective", 0.9 if up else 0.1), ("moderate_selectivity", 0.5), ("broad_selectivity", 0.1 if up else 0.9))
    return " UNION ALL ".join(
        f"""SELECT '{p.table_id}' AS table_id, '{p.column}' AS "column", '{p.operator}' AS operator, {p.parameter_position} AS parameter_position, '{m}' AS method,
        round(c, 6) AS cutoff, (SELECT count(*) FROM {p.table_id} WHERE {p.column} {p.operator} c) AS row_count
        FROM (SELECT quantile_cont({p.column}, {q}) AS c FROM {p.table_id}) x"""
        for m, q in tiers
    )


def _moment_sql(p: Predicate) -> str:
    up = p.operator in (">", ">=")
    anchor, edge, sign = ("max", "min", "-") if up else ("min", "max", "+")
    col = p.column
    return " UNION ALL ".join(
        f"""SELECT '{p.table_id}' AS table_id, '{col}' AS "column", '{p.operator}' AS operator, {p.parameter_position} AS parameter_position, '{m}' AS method,
        strftime(c, '%Y-%m-%d %H:%M:%S') AS cutoff, (SELECT count(*) FROM {p.table_id} WHERE {col} {p.operator} c) AS row_count
        FROM (SELECT {e} AS c FROM {p.table_id}) x"""
        for m, e in (
            ("recent_window", f"{anchor}({col}) {sign} INTERVAL 7 DAY"),
            ("monthly_window", f"{anchor}({col}) {sign} INTERVAL 30 DAY"),
            ("full_window", f"{edge}({col})"),
        )
    )


_ALL_EQUAL = " UNION ALL ".join(_equality_sql(t, c) for t, cs in _EQUAL.items() for c in cs)


@query(
    "p01_table_totals",
    sql=" UNION ALL ".join(
        f"SELECT '{t}' AS table_id, count(*) AS total_row_count FROM {t}" for t in _EQUAL
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_totals({t: table(spark, sf_dir, t) for t in _EQUAL})


@query("p02_equality_probes", sql=_ALL_EQUAL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        profile.equality_probes(
            profile.frequencies(table(spark, sf_dir, t), columns, "string")
        ).withColumn("table_id", F.lit(t))
        for t, columns in _EQUAL.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p03_numeric_range_probes", sql=" UNION ALL ".join(_numeric_sql(p) for p in _NUMERIC))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [p.column for p in _NUMERIC]
    freq = profile.frequencies(table(spark, sf_dir, "lineitem"), columns, "double")
    probes = profile.numeric_range_probes(profile.ranked_cutoffs(freq), _NUMERIC)
    return probes.withColumn("cutoff", F.round("cutoff", 6)).withColumn(
        "table_id", F.lit("lineitem")
    )


@query("p04_timestamp_window_probes", sql=" UNION ALL ".join(_moment_sql(p) for p in _MOMENTS))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = profile.timestamp_window_probes(table(spark, sf_dir, "orders"), _MOMENTS)
    return probes.withColumn(
        "cutoff", F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss")
    ).withColumn("table_id", F.lit("orders"))


@query(
    "p05_realized_selectivity",
    sql=f"""WITH p AS ({_ALL_EQUAL}), t AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS total_row_count FROM {t}" for t in _EQUAL)})
    SELECT table_id, "column", method, row_count, total_row_count, round(row_count / total_row_count, 9) AS selectivity,
      concat('sha256:', sha256(value)) AS value_hash, true AS is_redacted FROM p JOIN t USING (table_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in _EQUAL}
    parts = [
        profile.equality_probes(profile.frequencies(df, _EQUAL[t], "string")).withColumn(
            "table_id", F.lit(t)
        )
        for t, df in tables.items()
    ]
    probes = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        profile.realized(probes, profile.table_totals(tables))
        .withColumn("selectivity", F.round("selectivity", 9))
        .drop("redacted_value")
    )


_PREDICATES = [
    *_NUMERIC,
    *_MOMENTS,
    Predicate("customer", "c_mktsegment", 1, "=", "equality"),
    Predicate("orders", "o_orderstatus", 3, "=", "equality"),
]


@query(
    "p06_realize_probes",
    sql=f"""WITH p AS (
      SELECT table_id, "column", operator, parameter_position, method, row_count FROM ({" UNION ALL ".join(_numeric_sql(p) for p in _NUMERIC)}) a
      UNION ALL SELECT table_id, "column", operator, parameter_position, method, row_count FROM ({" UNION ALL ".join(_moment_sql(p) for p in _MOMENTS)}) b
      UNION ALL SELECT table_id, "column", '=', 1, method, row_count FROM ({_equality_sql("customer", "c_mktsegment")}) c
      UNION ALL SELECT table_id, "column", '=', 3, method, row_count FROM ({_equality_sql("orders", "o_orderstatus")}) d),
    t AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS total_row_count FROM {t}" for t in _EQUAL)})
    SELECT table_id, "column", operator, parameter_position, method, row_count, total_row_count, round(row_count / total_row_count, 9) AS selectivity
    FROM p JOIN t USING (table_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in _EQUAL}
    return (
        profile.realize_probes(tables, _PREDICATES)
        .withColumn("selectivity", F.round("selectivity", 9))
        .drop("value_hash", "is_redacted", "redacted_value")
    )


@query(
    "p07_key_pools",
    sql="""SELECT key_value, row_number() OVER (ORDER BY key_value) - 1 AS pool_index
    FROM (SELECT DISTINCT l_partkey AS key_value FROM lineitem WHERE l_partkey IS NOT NULL) k""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.key_pool(table(spark, sf_dir, "lineitem"), "l_partkey")
