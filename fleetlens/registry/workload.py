"""Capture and workload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import statements, workload
from fleetlens.registry.base import query
from fleetlens.registry.inputs import define, frame
from fleetlens.sources import capture as source
from fleetlens.sources.scratch import new_path

# Catalog of the given tables, as the statements see them.
define(
    "catalog_columns",
    """
SELECT * FROM (VALUES
  ('public', 'customer', 'public.customer', 'c_custkey', 'bigint', 1),
  ('public', 'customer', 'public.customer', 'c_name', 'text', 2),
  ('public', 'customer', 'public.customer', 'c_acctbal', 'double precision', 4),
  ('public', 'lineitem', 'public.lineitem', 'l_orderkey', 'bigint', 1),
  ('public', 'lineitem', 'public.lineitem', 'l_quantity', 'numeric(12,2)', 5),
  ('public', 'lineitem', 'public.lineitem', 'l_shipdate', 'timestamp without time zone', 11),
  ('public', 'nation', 'public.nation', 'n_nationkey', 'integer', 1),
  ('public', 'orders', 'public.orders', 'o_orderkey', 'bigint', 1),
  ('public', 'orders', 'public.orders', 'o_custkey', 'bigint', 2),
  ('public', 'orders', 'public.orders', 'o_orderstatus', 'text', 3),
  ('public', 'orders', 'public.orders', 'o_totalprice', 'numeric(12,2)', 4),
  ('public', 'orders', 'public.orders', 'o_orderdate', 'timestamp without time zone', 5),
  ('public', 'supplier', 'public.supplier', 's_name', 'text', 2),
  ('public', 'supplier', 'public.supplier', 's_nationkey', 'integer', 3),
  ('public', 'supplier', 'public.supplier', 's_acctbal', 'numeric(12,2)', 4)
) AS t(schema_name, table_name, table_id, name, data_type, ordinal)
""",
)

_SHAPE = "concat(event_type_of, CASE WHEN event_type_of = 'error' THEN CAST(site_line % 4 AS STRING) ELSE '' END)"
# What each statement shape must become: shape, normal form, class, relations, types.
_EXPECTED = f"""
expected AS (SELECT * FROM (VALUES
 ('view', 'select o_orderkey , o_totalprice from orders where o_custkey = $1 and o_orderstatus = $2', 'read', 'public.orders', 'bigint,text'),
 ('click', 'select l_quantity from public.lineitem where l_orderkey = $1 and l_quantity > $2 limit $3', 'read', 'public.lineitem', 'bigint,numeric(12,2),unknown'),
 ('purchase', 'insert into orders ( o_orderkey , o_custkey ) values ( $1 , $2 )', 'write', 'public.orders', 'unknown,unknown'),
 ('signup', 'update customer set c_name = $2 , c_acctbal = $3 where c_custkey = $1 :: bigint', 'write', 'public.customer', 'unknown,unknown,unknown'),
 ('error0', NULL, 'unsupported', '', ''),
 ('error1', NULL, 'unsupported', '', ''),
 ('error2', 'select s_name from supplier , nation n , missing where s_nationkey = n_nationkey and $1 <= s_acctbal', 'read', 'public.nation,public.supplier', 'numeric(12,2)'),
 ('error3', 'select c.c_name from customer c join orders o on c.c_custkey = o.o_custkey where ( o.o_totalprice > $1 or c.c_acctbal < $2 ) and o.o_orderdate >= $3 and c.c_name is not null', 'read', 'public.customer,public.orders', 'numeric(12,2),double precision,timestamp without time zone')
) AS t(shape, normal, class, relations, types)),
shaped AS (SELECT DISTINCT statement, {_SHAPE} AS shape FROM (SELECT *, query_id AS event_type_of FROM capture) c),
described AS (SELECT statement, coalesce(normal, statement) AS normalized_sql, class AS statement_class, relations, types,
  CASE shape WHEN 'error0' THEN 'statement word is not recognised' WHEN 'error1' THEN 'exactly one statement is required, found a batch' END AS parse_error
  FROM shaped JOIN expected USING (shape)),
printed AS (SELECT *, concat('sha256:', sha256(concat('{{"normalized_sql":"', normalized_sql, '","parameter_types":[',
  CASE WHEN types = '' THEN '' ELSE concat('"', replace(replace(replace(types, '(12,2)', '(12;2)'), ',', '","'), ';', ','), '"') END, '],"relations":[',
  CASE WHEN relations = '' THEN '' ELSE concat('"', replace(relations, ',', '","'), '"') END, ']}}'))) AS query_id FROM described)
"""


def statements_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "capture").select("statement")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "catalog_columns").selectExpr("schema_name", "table_name AS name")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.describe_statements(
        statements_of(spark, sf_dir),
        catalog_tables(spark, sf_dir),
        frame(spark, sf_dir, "catalog_columns"),
    )


_RELATIONS = """CASE query_id WHEN 'view' THEN 'public.orders' WHEN 'click' THEN 'public.lineitem'
 WHEN 'purchase' THEN 'public.orders' WHEN 'signup' THEN 'public.customer'
 ELSE 'public.customer,public.orders' END"""


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture log with nested columns and the event type as query id."""
    log = frame(spark, sf_dir, "capture")
    site = F.struct(
        F.col("site_path").alias("path"),
        F.col("site_line").alias("line"),
        F.col("site_symbol").alias("symbol"),
    )
    return log.select(
        *workload.OPERATION,
        "sequence",
        "duration_us",
        "query_id",
        "statement_class",
        "rowcount",
        "transaction_id",
        F.array("bind").alias("bind_signature"),
        F.when(F.col("site_path").isNull(), F.array().cast(f"array<struct<path:string,line:bigint,symbol:string>>"))
        .otherwise(F.array(site))
        .alias("call_sites"),
        "bind",
    )


def captured_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query id of `captured`."""
    return (
        frame(spark, sf_dir, "capture")
        .select("query_id", "statement_class")
        .distinct()
        .select(
            "query_id",
            "statement_class",
            F.col("query_id").alias("normalized_sql"),
            F.when(F.col("query_id") == "error", "failed").alias("parse_error"),
            F.split(F.expr(_RELATIONS), ",").alias("relations"),
        )
    )


@query(
    "c06_normalize_statements",
    inputs="capture",
    sql=f"WITH {_EXPECTED} SELECT statement, normalized_sql FROM described",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.normalize_statements(statements_of(spark, sf_dir)).select(
        "statement", "normalized_sql"
    )


@query(
    "c07_classify_statements",
    inputs="capture",
    sql=f"""WITH {_EXPECTED} SELECT statement_class, parse_error, count(*) AS executions
    FROM capture JOIN described d USING (statement) GROUP BY ALL""".replace(
        "SELECT statement_class, parse", "SELECT d.statement_class, parse"
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = statements_of(spark, sf_dir)
    classes = statements.normalize_statements(log)
    return (
        log.groupBy("statement")
        .agg(F.count("*").alias("n"))
        .join(classes, "statement")
        .groupBy("statement_class", "parse_error")
        .agg(F.sum("n").alias("executions"))
    )


@query(
    "c08_resolve_relations",
    inputs="capture",
    sql=f"""WITH {_EXPECTED} SELECT DISTINCT normalized_sql, unnest(string_split(relations, ',')) AS relation
    FROM described WHERE relations <> ''""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalized = statements.normalize_statements(statements_of(spark, sf_dir))
    return statements.resolve_relations(normalized, catalog_tables(spark, sf_dir))


@query(
    "c09_infer_parameter_types",
    inputs="capture",
    sql=f"""WITH {_EXPECTED} SELECT DISTINCT normalized_sql, generate_subscripts(l, 1) AS position,
      replace(unnest(l), ';', ',') AS data_type FROM (
      SELECT normalized_sql, string_split(replace(types, '(12,2)', '(12;2)'), ',') AS l FROM described WHERE types <> '')""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalized = statements.normalize_statements(statements_of(spark, sf_dir))
    return statements.infer_parameter_types(normalized, frame(spark, sf_dir, "catalog_columns"))


@query(
    "c10_fingerprint_queries",
    inputs="capture",
    sql=f"WITH {_EXPECTED} SELECT statement, query_id FROM printed",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("statement", "query_id")


@query(
    "c11_query_catalog",
    inputs="capture",
    sql="""WITH q AS (SELECT app_id, run_id, query_id, count(*) AS executions, min(statement_class) AS statement_class,
      CASE WHEN query_id = 'error' THEN 'failed' END AS parse_error FROM capture GROUP BY ALL),
    s AS (SELECT app_id, run_id, query_id, concat(site_path, ':', site_line, ':', site_symbol) AS site, min(sequence) AS seen
      FROM capture WHERE site_path IS NOT NULL GROUP BY ALL),
    l AS (SELECT app_id, run_id, query_id, string_agg(site, '|' ORDER BY seen) AS sites FROM s GROUP BY ALL)
    SELECT app_id, run_id, query_id, executions, statement_class, parse_error, coalesce(sites, '') AS call_sites
    FROM q LEFT JOIN l USING (app_id, run_id, query_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workload.query_catalog(
        captured(spark, sf_dir), captured_queries(spark, sf_dir)
    )
    sites = F.transform(
        "call_sites", lambda s: F.concat_ws(":", s["path"], s["line"].cast("string"), s["symbol"])
    )
    return found.withColumn("call_sites", F.array_join(sites, "|")).drop("normalized_sql")


_OPERATION_SQL = """
    WITH c AS (SELECT *, {relations} AS relations FROM capture),
    r AS (SELECT DISTINCT app_id, run_id, node_id, phase, statement_class, unnest(string_split(relations, ',')) AS relation FROM c),
    t AS (SELECT app_id, run_id, node_id, phase,
        string_agg(relation, ',' ORDER BY relation) FILTER (WHERE statement_class = 'read') AS tables_read,
        string_agg(relation, ',' ORDER BY relation) FILTER (WHERE statement_class = 'write') AS tables_written
      FROM r GROUP BY ALL),
    o AS (SELECT app_id, run_id, node_id, phase, count(*) AS query_count, nullif(sum(duration_us), 0) AS observed_duration_us,
        arg_min(concat(site_path, ':', site_line), sequence) FILTER (WHERE site_path IS NOT NULL) AS entry_point
      FROM c GROUP BY ALL)
    SELECT o.app_id, o.run_id, o.node_id, o.phase, query_count, CAST(observed_duration_us AS BIGINT) AS observed_duration_us,
      entry_point, coalesce(tables_read, '') AS tables_read, coalesce(tables_written, '') AS tables_written
    FROM o JOIN t USING (app_id, run_id, node_id, phase)""".replace("{relations}", _RELATIONS)


def printable_operations(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        *workload.OPERATION,
        "query_count",
        "observed_duration_us",
        F.concat(F.col("entry_point.path"), F.lit(":"), F.col("entry_point.line")).alias("entry_point"),
        F.array_join("tables_read", ",").alias("tables_read"),
        F.array_join("tables_written", ",").alias("tables_written"),
    )


@query("c12_operation_rollup", inputs="capture", sql=_OPERATION_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printable_operations(
        workload.operation_rollup(captured(spark, sf_dir), captured_queries(spark, sf_dir))
    )


COUNTS_SQL = """SELECT app_id, run_id, node_id, phase, query_id, count(*) AS executions FROM capture GROUP BY ALL"""


@query("c13_operation_query_counts", inputs="capture", sql=COUNTS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.operation_query_counts(captured(spark, sf_dir))


_TRANSACTION_SQL = """WITH t AS (SELECT transaction_id, max(rowcount) >= 50 AS committed FROM capture GROUP BY 1 HAVING max(rowcount) >= 20),
    c AS (SELECT *, row_number() OVER (PARTITION BY app_id, run_id, node_id, phase, transaction_id ORDER BY sequence) AS position FROM capture)
    SELECT app_id, run_id, node_id, phase, c.transaction_id, position, query_id, coalesce(committed, false) AS committed
    FROM c LEFT JOIN t USING (transaction_id)"""


def _outcomes(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(*workload.RUN, "transaction_id")
        .agg(F.max("rowcount").alias("top"))
        .where("top >= 20")
        .select(*workload.RUN, "transaction_id", (F.col("top") >= 50).alias("committed"))
    )


@query("c14_transaction_rollup", inputs="capture", sql=_TRANSACTION_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = captured(spark, sf_dir)
    return workload.transaction_rollup(events, _outcomes(events), width=4096).drop("sequence")


AMPLIFICATION_SQL = """
    WITH c AS (SELECT *, row_number() OVER w AS nth,
        lag(query_id) OVER o AS p_query, lag(statement_class) OVER o AS p_class, lag(rowcount) OVER o AS p_rows
      FROM capture WINDOW o AS (PARTITION BY app_id, run_id, node_id, phase ORDER BY sequence),
        w AS (PARTITION BY app_id, run_id, node_id, phase, query_id ORDER BY sequence)),
    g AS (SELECT app_id, run_id, node_id, phase, query_id, count(*) AS n, count(DISTINCT coalesce(bind, '<none>')) AS binds,
        max(p_query) FILTER (WHERE nth = 1) AS parent_query, max(p_class) FILTER (WHERE nth = 1) AS p_class,
        max(p_rows) FILTER (WHERE nth = 1) AS p_rows,
        max(CASE WHEN site_path IS NOT NULL THEN concat(site_path, ':', site_line) END) FILTER (WHERE nth = 1) AS call_site
      FROM c GROUP BY ALL)
    SELECT app_id, run_id, node_id, phase, parent_query, query_id AS child_query, n AS repetitions,
      CASE WHEN binds = 1 THEN 'repeated_query' WHEN p_class = 'read' AND p_rows = n THEN 'observed_n_plus_one'
        ELSE 'possible_amplification' END AS classification{extra}
    FROM g WHERE n >= 5 AND parent_query IS NOT NULL"""

_AMPLIFICATION = [
    *workload.OPERATION,
    "parent_query",
    "child_query",
    "repetitions",
    "classification",
]


@query("c15_detect_amplification", inputs="capture", sql=AMPLIFICATION_SQL.replace("{extra}", ""))
def detect_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workload.detect_amplification(captured(spark, sf_dir), width=1024)
    return found.select(*_AMPLIFICATION)


@query(
    "c16_name_amplification_relationship",
    inputs="capture",
    sql=f"""WITH fk AS (SELECT * FROM (VALUES ('fk_line_order', 'public.lineitem', 'public.orders'), ('fk_order_customer', 'public.orders', 'public.customer'),
        ('fk_customer_a', 'public.customer', 'public.orders'), ('fk_customer_b', 'public.customer', 'public.orders')) AS t(name, child, parent)),
    u AS (SELECT child, parent, CASE WHEN count(*) = 1 THEN min(name) END AS name FROM fk GROUP BY ALL),
    a AS ({AMPLIFICATION_SQL.replace("{extra}", "")})
    SELECT app_id, run_id, node_id, phase, parent_query, child_query, name AS relationship_name
    FROM (SELECT *, {_RELATIONS.replace("query_id", "parent_query")} AS pr, {_RELATIONS.replace("query_id", "child_query")} AS cr FROM a) x
    LEFT JOIN u ON u.child = x.cr AND u.parent = x.pr""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.sql(
        """SELECT * FROM VALUES ('fk_line_order', 'public.lineitem', 'public.orders'),
        ('fk_order_customer', 'public.orders', 'public.customer'), ('fk_customer_a', 'public.customer', 'public.orders'),
        ('fk_customer_b', 'public.customer', 'public.orders') AS t(name, table_id, referenced_table)"""
    )
    found = workload.detect_amplification(captured(spark, sf_dir), width=1024)
    return workload.name_relationships(found, captured_queries(spark, sf_dir), keys).select(
        *workload.OPERATION, "parent_query", "child_query", "relationship_name"
    )


_CALL_SITE_SQL = AMPLIFICATION_SQL.replace("{extra}", ", call_site").replace(
    "SELECT app_id, run_id, node_id, phase, parent_query, query_id AS child_query, n AS repetitions,",
    "SELECT app_id, run_id, node_id, phase, query_id AS child_query, n AS repetitions,",
)


def _call_sites(events: DataFrame) -> DataFrame:
    found = workload.amplification_call_sites(workload.detect_amplification(events, width=1024), events)
    site = F.col("call_site")
    return found.select(
        *workload.OPERATION,
        "child_query",
        "repetitions",
        "classification",
        F.concat(site["path"], F.lit(":"), site["line"]).alias("call_site"),
    )


@query("c17_amplification_call_site", inputs="capture", sql=_CALL_SITE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_sites(captured(spark, sf_dir))


def sharing_numbers(events: DataFrame) -> DataFrame:
    """The same log with numbers that up to three events share, arriving in the opposite order."""
    return events.withColumns(
        {"sequence": F.floor(F.col("sequence") / 3), "arrival": 2 - F.col("sequence") % 3}
    )


def _shared(sql: str) -> str:
    return sql.replace("ORDER BY sequence", "ORDER BY sequence // 3, sequence % 3 DESC")


@query("c14_transaction_shared_numbers", inputs="capture", sql=_shared(_TRANSACTION_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sharing_numbers(captured(spark, sf_dir))
    return workload.transaction_rollup(events, _outcomes(events), width=1024).drop("sequence")


@query("c15_amplification_shared_numbers", inputs="capture", sql=_shared(AMPLIFICATION_SQL).replace("{extra}", ""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = workload.detect_amplification(sharing_numbers(captured(spark, sf_dir)), width=64)
    return found.select(*_AMPLIFICATION)


@query("c17_call_site_shared_numbers", inputs="capture", sql=_shared(_CALL_SITE_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_sites(sharing_numbers(captured(spark, sf_dir)))


# One run per user and day for run-level checks.
define(
    "run_facts",
    """
SELECT concat('app-', user_id % 10) AS app_id, concat(user_id, '/', CAST(CAST(ts AS DATE) AS STRING)) AS run_id,
  count(*) AS event_count, sum(CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) AS malformed_lines,
  max(CASE WHEN k % 13 = 0 AND event_type = 'error' THEN 2 ELSE 0 END) AS exit_code
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}) e
GROUP BY concat('app-', user_id % 10), concat(user_id, '/', CAST(CAST(ts AS DATE) AS STRING))
""",
)


@query(
    "c18_capture_coverage",
    inputs="run_facts",
    sql="""SELECT app_id, run_id, CASE WHEN exit_code <> 0 OR malformed_lines > 0 THEN 'partial' ELSE 'complete_for_selection' END AS coverage,
      CASE WHEN exit_code <> 0 THEN concat('test command exited ', exit_code, '; ', event_count, ' query event(s) captured before it stopped')
        WHEN malformed_lines > 0 THEN concat(malformed_lines, ' capture line(s) failed to parse')
        ELSE 'capture completed for the selected test command' END AS boundary_note FROM run_facts""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.capture_coverage(frame(spark, sf_dir, "run_facts")).select(
        "app_id", "run_id", "coverage", "boundary_note"
    )


@query(
    "c19_describe_bind_values",
    inputs="capture",
    sql="""SELECT sequence, '1' AS position, 'str' AS python_type, concat('sha256:', sha256(concat('''', bind, ''''))) AS value_hash, true AS is_redacted
      FROM capture WHERE bind IS NOT NULL
    UNION ALL SELECT sequence, '2', 'int', concat('sha256:', sha256(CAST(rowcount AS VARCHAR))), true FROM capture WHERE bind IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """CASE WHEN bind IS NULL THEN array() ELSE array(
      array(struct('1' AS position, 'str' AS python_type, concat('\\'', bind, '\\'') AS value),
            struct('2' AS position, 'int' AS python_type, cast(rowcount AS string) AS value)),
      array(struct('1' AS position, 'str' AS python_type, 'second row of a batch' AS value))) END"""
    events = captured(spark, sf_dir).select("sequence", F.expr(rows).alias("bind_rows"))
    return (
        workload.describe_bind_values(events)
        .select("sequence", F.inline("parameters"))
        .drop("redacted_value")
    )


define(
    "test_reports",
    """
SELECT app_id, run_id, concat(node_id, '::', rowcount % 20) AS node_id, sequence AS pos,
  CASE query_id WHEN 'signup' THEN 'setup' WHEN 'error' THEN 'teardown' WHEN 'view' THEN 'call' ELSE 'setup' END AS stage,
  CASE WHEN rowcount % 3 = 0 THEN 'failed' WHEN rowcount % 11 = 0 THEN 'skipped' ELSE 'passed' END AS outcome
FROM {capture}
""",
)
_OUTCOMES = """o AS (SELECT app_id, run_id, node_id, coalesce(arg_max(outcome, pos) FILTER (WHERE stage = 'call'),
      CASE WHEN bool_or(stage = 'setup' AND outcome = 'failed') THEN 'failed' END) AS outcome FROM test_reports GROUP BY ALL)"""


@query(
    "c20_test_outcomes",
    inputs="test_reports",
    sql=f"WITH {_OUTCOMES} SELECT * FROM o WHERE outcome IS NOT NULL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.test_outcomes(frame(spark, sf_dir, "test_reports"))


@query(
    "c20_test_totals",
    inputs="test_reports",
    sql=f"""WITH {_OUTCOMES} SELECT app_id, run_id, count(*) AS selected_tests, count(*) FILTER (WHERE outcome = 'passed') AS passed_tests,
      count(*) FILTER (WHERE outcome = 'failed') AS failed_tests FROM o WHERE outcome IS NOT NULL GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.test_totals(frame(spark, sf_dir, "test_reports"))


@query(
    "c21_extract_predicates",
    inputs="capture",
    sql=f"""WITH {_EXPECTED}, p AS (SELECT * FROM (VALUES
      ('view', 0, 'public.orders', 'o_custkey', 1, '=', 'equality'), ('view', 1, 'public.orders', 'o_orderstatus', 2, '=', 'equality'),
      ('click', 0, 'public.lineitem', 'l_orderkey', 1, '=', 'equality'), ('click', 1, 'public.lineitem', 'l_quantity', 2, '>', 'numeric_range'),
      ('error2', 1, 'public.supplier', 's_acctbal', 1, '<=', 'numeric_range'), ('error3', 1, 'public.orders', 'o_orderdate', 3, '>=', 'timestamp_range')
    ) AS t(shape, ordinal, table_id, name, parameter_position, operator, kind))
    SELECT DISTINCT query_id, ordinal, table_id, concat(table_id, '.', name) AS column_id, parameter_position, operator, kind
    FROM printed JOIN shaped USING (statement) JOIN p USING (shape)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = described(spark, sf_dir).dropDuplicates(["query_id"])
    return statements.extract_predicates(queries, frame(spark, sf_dir, "catalog_columns"))


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture events as text lines: some cut short, some invalid, some blank."""
    parameters = F.array(
        F.struct(
            F.lit("1").alias("position"),
            F.lit("str").alias("python_type"),
            F.concat(F.lit("sha256:"), F.sha2("bind", 256)).alias("value_hash"),
        )
    )
    events = captured(spark, sf_dir).select(
        "app_id",
        "run_id",
        "sequence",
        F.when(F.col("rowcount") % 19 == 0, -1).otherwise(F.col("duration_us")).alias("duration_us"),
        F.col("query_id").alias("statement"),
        F.lit("postgresql").alias("dialect"),
        parameters.alias("parameters"),
        "rowcount",
        "transaction_id",
        "node_id",
        F.when(F.col("rowcount") % 29 == 0, "between").otherwise(F.col("phase")).alias("phase"),
        F.lit(1).alias("process_id"),
        F.lit(1).alias("thread_id"),
        F.when(F.col("rowcount") % 37 == 0, "").alias("error_class"),
        F.array(
            F.struct(
                F.lit("app/a.py").alias("path"),
                F.when(F.col("rowcount") % 41 == 0, 0).otherwise(F.col("rowcount") + 1).alias("line"),
                F.concat(F.lit("sha256:"), F.sha2("query_id", 256)).alias("content_hash"),
            )
        ).alias("call_sites"),
    )
    plain = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
    text = F.when(
        F.col("rowcount") % 31 == 0,
        F.replace(plain, F.lit('"thread_id":1'), F.lit('"thread_id":"many"')),
    ).otherwise(plain)
    line = (
        F.when(F.col("rowcount") % 46 == 0, "\t")
        .when(F.col("rowcount") % 23 == 0, "   ")
        .when(F.col("rowcount") % 17 == 0, F.substring(text, 1, 40))
        .otherwise(text)
    )
    return events.select(line.alias("value"))


_GOOD = " AND ".join(f"rowcount % {n} <> 0" for n in (23, 17, 19, 29, 31, 37, 41))


@query(
    "c01_read_capture_events",
    inputs="capture",
    sql=f"SELECT app_id, sequence, duration_us, node_id, phase, query_id AS statement, rowcount FROM capture WHERE {_GOOD}",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "capture-lines")
    capture_lines(spark, sf_dir).write.text(path)
    events, _malformed = source.read_capture_events(spark, path)
    return events.select(
        "app_id", "sequence", "duration_us", "node_id", "phase", "statement", "rowcount"
    )


@query(
    "c01_malformed_lines",
    inputs="capture",
    sql=f"SELECT count(*) AS malformed_lines FROM capture WHERE rowcount % 23 <> 0 AND NOT ({_GOOD})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "capture-lines")
    capture_lines(spark, sf_dir).write.text(path)
    _events, malformed = source.read_capture_events(spark, path)
    return malformed.agg(F.sum("malformed_lines").alias("malformed_lines"))


@query(
    "c02_read_capture_summary",
    inputs="run_facts",
    sql="""SELECT app_id, run_id, CASE WHEN event_count % 4 < 2 THEN event_count ELSE 0 END AS selected_tests,
      CASE WHEN event_count % 4 < 2 THEN event_count - malformed_lines ELSE 0 END AS passed_tests,
      CASE WHEN event_count % 4 < 2 THEN malformed_lines ELSE 0 END AS failed_tests,
      CASE WHEN event_count % 4 = 1 THEN 1 ELSE 0 END AS outcomes FROM run_facts""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = frame(spark, sf_dir, "run_facts")
    text = F.concat(
        F.lit('{"selected_tests":'),
        F.col("event_count").cast("string"),
        F.lit(',"passed_tests":'),
        (F.col("event_count") - F.col("malformed_lines")).cast("bigint").cast("string"),
        F.lit(',"failed_tests":'),
        F.col("malformed_lines").cast("bigint").cast("string"),
        F.when(F.col("event_count") % 4 == 1, ',"transaction_outcomes":{"t1":true}}').otherwise("}"),
    )
    summary = F.when(F.col("event_count") % 4 == 2, F.substring(text, 1, 20)).when(
        F.col("event_count") % 4 < 2, text
    )
    path = new_path(spark, "summaries")
    facts.select("app_id", "run_id", summary.alias("summary")).where("summary IS NOT NULL").write.json(path)
    runs = source.read_capture_summaries(spark, facts.select("app_id", "run_id"), path)
    return runs.withColumn("outcomes", F.size("transaction_outcomes").cast("long")).drop(
        "transaction_outcomes"
    )
