"""Data generation queries; row counts and key pools come from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import generate
from fleetlens.operators.generate import ColumnSpec, TableSpec, component_seed
from fleetlens.operators.profile import key_pool
from fleetlens.registry.base import query
from fleetlens.registry.catalog import catalog
from fleetlens.registry.inputs import define, frame, table
from fleetlens.sources.scratch import new_path

SEED = 42
EPOCH = "2026-01-01 00:00:00"


def _stream(name: str) -> int:
    return component_seed(SEED, "public.made", f"public.made.{name}", 1)


def _hash(name: str, row: str = "row_id") -> str:
    return f"CAST(concat('0x', substr(sha256(concat('{_stream(name)}:', {row})), 1, 15)) AS BIGINT)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"))


_ROWS = "r AS (SELECT o_orderkey AS row_id FROM orders)"


@query(
    "g02_component_seed",
    inputs="phys_columns",
    sql=f"""SELECT app_id, column_id, CAST(concat('0x', substr(sha256(concat('[{SEED},"', table_id, '","', column_id, '",1]')), 1, 15)) AS BIGINT) AS component_seed FROM phys_columns""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "phys_columns").select(
        "app_id",
        "column_id",
        generate.component_seed_column(
            F.lit(SEED), F.col("table_id"), F.col("column_id"), F.lit(1)
        ).alias("component_seed"),
    )


def _unique_facts(values: DataFrame, held: DataFrame) -> DataFrame:
    """Rows, distinct values, and values the held ones already had."""
    marked = values.join(held.withColumn("held", F.lit(True)), "value", "left")
    return marked.agg(
        F.count("*").alias("rows"),
        F.count_distinct("value").alias("distinct_values"),
        F.count("held").alias("collisions"),
        F.count_distinct("row").alias("distinct_rows"),
    )


_UNIQUE_SQL = "SELECT count(*) AS rows, count(*) AS distinct_values, 0 AS collisions, count(*) AS distinct_rows FROM orders"


@query("g03_gen_unique_int", sql=_UNIQUE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("value"))
    rows = table(spark, sf_dir, "orders").count()
    return _unique_facts(generate.unique_values(spark, _stream("id"), rows, held), held)


@query("g03_gen_unique_text", sql=_UNIQUE_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "part").select(
        F.concat(F.lit("sku-"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("value")
    )
    rows = table(spark, sf_dir, "orders").count()
    return _unique_facts(generate.unique_values(spark, _stream("sku"), rows, held, "sku"), held)


@query(
    "g04_gen_foreign_key",
    sql=f"""WITH {_ROWS}, p AS (SELECT c_custkey AS key_value, row_number() OVER (ORDER BY c_custkey) - 1 AS pool_index FROM customer WHERE c_acctbal > 0)
    SELECT row_id AS "row", key_value AS customer_id FROM r JOIN p ON p.pool_index = {_hash("customer_id")} % (SELECT count(*) FROM p)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = key_pool(table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    return generate.foreign_key_values(
        _rows(spark, sf_dir), _stream("customer_id"), pool, "customer_id"
    )


@query(
    "g05_gen_check_set",
    sql=f"""WITH {_ROWS} SELECT row_id AS "row", ['cancelled', 'paid', 'pending'][{_hash("status")} % 3 + 1] AS status, {_hash("active")} % 2 = 0 AS active FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    literals = F.array(F.lit("cancelled"), F.lit("paid"), F.lit("pending"))
    flags = F.array(F.lit(True), F.lit(False))
    return _rows(spark, sf_dir).select(
        "row",
        generate.pick(_stream("status"), literals).alias("status"),
        generate.pick(_stream("active"), flags).alias("active"),
    )


@query(
    "g06_gen_check_range",
    sql=f"""WITH {_ROWS} SELECT row_id AS "row", -5 + {_hash("quantity")} % 16 AS quantity FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.lit(-5).cast("long"), F.lit(10).cast("long")
    return _rows(spark, sf_dir).select(
        "row", generate.in_range(_stream("quantity"), low, high).alias("quantity")
    )


@query(
    "g07_gen_timestamp",
    sql=f"""WITH {_ROWS} SELECT row_id AS "row", strftime(TIMESTAMP '{EPOCH}' - to_seconds({_hash("created_at")} % (365 * 86400)), '%Y-%m-%d %H:%M:%S') AS created_at,
      strftime(TIMESTAMP '{EPOCH}' - to_seconds({_hash("shipped")} % (3650 * 86400)), '%Y-%m-%d %H:%M:%S') AS shipped FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    shape = "yyyy-MM-dd HH:mm:ss"
    return _rows(spark, sf_dir).select(
        "row",
        F.date_format(generate.moment(_stream("created_at"), epoch, generate.RECENT_DAYS), shape).alias("created_at"),
        F.date_format(generate.moment(_stream("shipped"), epoch, generate.FALLBACK_DAYS), shape).alias("shipped"),
    )


@query(
    "g08_gen_fallback",
    sql=f"""WITH {_ROWS} SELECT row_id AS "row", concat('user', row_id, '@example.test') AS email, {_hash("points")} % 1000000 AS points,
      CAST({_hash("price")} % 100000000 AS DOUBLE) / 100 AS price, concat('note-', row_id) AS note, NULL AS tags FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    return _rows(spark, sf_dir).select(
        "row",
        generate.email().alias("email"),
        *[
            generate.fallback(family, _stream(name), name, epoch).alias(name)
            for name, family in (("points", "integer"), ("price", "numeric"), ("note", "text"), ("tags", None))
        ],
    )


_UNIQUE = """ky AS (SELECT DISTINCT app_id, columns AS column_id FROM phys_constraints WHERE kind IN ('primary_key', 'unique')),
    fam AS (SELECT *, CASE WHEN data_type IN ('integer', 'bigint') THEN 'integer' WHEN starts_with(data_type, 'character') THEN 'text' WHEN starts_with(data_type, 'numeric') THEN 'numeric'
      WHEN data_type = 'boolean' THEN 'boolean' WHEN starts_with(data_type, 'timestamp') THEN 'timestamp' END AS family, coalesce(contains(default_expression, 'nextval('), false) AS dbdef FROM phys_columns),
    un AS (SELECT f.app_id, f.column_id FROM fam f JOIN ky USING (app_id, column_id) WHERE NOT dbdef AND family IN ('integer', 'text'))"""


def _plan_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = catalog(spark, sf_dir, "phys")
    columns = p["columns"].withColumn("is_identity", F.lit(False)).withColumn("is_generated", F.lit(False))
    return columns, p["constraints"]


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    columns, constraints = _plan_inputs(spark, sf_dir)
    pools = frame(spark, sf_dir, "phys_tables").where("name NOT IN ('t3', 't6')").selectExpr(
        "app_id", "table_id", "CAST(10 AS BIGINT) AS pool_size"
    )
    deferred = columns.where("name = 'c2' AND nullable AND data_type = 'bigint'").select("app_id", "column_id")
    return generate.plan_columns(columns, constraints, pools, deferred)


_PLAN = f"""{_UNIQUE}, par AS (SELECT app_id, columns AS column_id, arg_max(referenced_table, (ordinal, name)) AS parent FROM phys_constraints WHERE kind = 'foreign_key' AND NOT contains(columns, ',') GROUP BY ALL),
    po AS (SELECT app_id, table_id FROM phys_tables WHERE name NOT IN ('t3', 't6')),
    chk AS (SELECT DISTINCT app_id, concat(table_id, '.', substr(expression, 2, instr(expression, ' ') - 2)) AS column_id FROM phys_constraints WHERE kind = 'check'),
    st AS (SELECT f.*, parent, (f.app_id, parent) IN (SELECT app_id, table_id FROM po) AS pooled, (f.app_id, f.column_id) IN (SELECT app_id, column_id FROM un) AS is_unique, (f.app_id, f.column_id) IN (SELECT app_id, column_id FROM chk) AS checked
      FROM fam f LEFT JOIN par USING (app_id, column_id)),
    sg AS (SELECT *, CASE WHEN name = 'c2' AND nullable AND data_type = 'bigint' THEN 'deferred_foreign_key' WHEN parent IS NOT NULL AND pooled THEN 'foreign_key' WHEN parent IS NOT NULL THEN NULL WHEN dbdef THEN 'database_default'
      WHEN is_unique AND family = 'integer' THEN 'unique_sequential_int' WHEN is_unique THEN 'unique_sequential_text' WHEN family = 'boolean' THEN 'boolean' WHEN checked AND family = 'integer' THEN 'check_recognized_range' WHEN family IS NOT NULL THEN 'uniform_fallback' END AS s FROM st),
    bad AS (SELECT app_id, table_id, concat(column_id, ': no value source for a NOT NULL ', data_type) AS reason FROM sg WHERE s IS NULL AND NOT nullable)"""


@query(
    "g09_plan_columns",
    inputs="phys_columns phys_constraints phys_tables",
    sql=f"""WITH {_PLAN} SELECT app_id, column_id, coalesce(s, 'null_fallback') AS strategy, coalesce(s, 'null_fallback') IN ('uniform_fallback', 'null_fallback') AS inferred FROM sg
    WHERE (app_id, table_id) NOT IN (SELECT app_id, table_id FROM bad)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[0].select("app_id", "column_id", "strategy", "inferred")


@query(
    "g09_plan_unsupported",
    inputs="phys_columns phys_constraints phys_tables",
    sql=f"""WITH {_PLAN} SELECT app_id, 'unsupported_check_constraint' AS kind, expression AS reason FROM phys_constraints c WHERE kind = 'check' AND NOT EXISTS (SELECT 1 FROM phys_columns p WHERE p.app_id = c.app_id AND p.column_id = concat(c.table_id, '.', substr(expression, 2, instr(expression, ' ') - 2)))
    UNION ALL SELECT app_id, 'unsupported_composite_foreign_key', name FROM phys_constraints WHERE kind = 'foreign_key' AND contains(columns, ',')
    UNION ALL SELECT f.app_id, 'unsupported_unique_constraint', concat(f.column_id, ': no distinctness strategy for ', data_type) FROM fam f JOIN ky USING (app_id, column_id) WHERE NOT dbdef AND coalesce(family, '') NOT IN ('integer', 'text')
    UNION ALL SELECT app_id, 'unsupported_column_type', reason FROM bad""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)[1]


define(
    "check_texts",
    """
SELECT o_orderkey AS id, n, o_orderkey % 12 AS shape, CASE o_orderkey % 12
    WHEN 0 THEN concat('(status IN (''', o_orderstatus, ''', ''it''''s''))')
    WHEN 1 THEN '((kind)::text = ANY ((ARRAY[''b''::character varying, ''a''::character varying])::text[]))'
    WHEN 2 THEN concat('((qty = ', n, ') OR (qty = 3))')
    WHEN 3 THEN concat('(qty BETWEEN ', n, ' AND ', 50, ')')
    WHEN 4 THEN concat('((qty >= ', n, ') AND (qty < 60))')
    WHEN 5 THEN concat('(qty > ', n, ')')
    WHEN 6 THEN concat('(length(name) > ', n, ')')
    WHEN 7 THEN '(a = 1 OR b = 2)'
    WHEN 8 THEN concat('(NOT (qty > ', n, '))')
    WHEN 9 THEN concat('((qty <= -', n, '))')
    WHEN 10 THEN concat('((qty > 1) AND (other < ', n, '))')
    ELSE concat('(price >= ', n, '.5)') END AS expression
FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) % 90 AS n FROM {orders}) o
""",
)


@query(
    "g10_recognize_checks",
    inputs="check_texts",
    sql="""WITH x AS (SELECT c.*, o_orderstatus AS s FROM check_texts c JOIN orders ON o_orderkey = id),
    k AS (SELECT *, CASE WHEN shape IN (0, 1, 2) THEN 'set' WHEN shape = 3 AND n <= 50 THEN 'range' WHEN shape = 4 AND n <= 59 THEN 'range' WHEN shape IN (5, 9) THEN 'range' END AS check_kind FROM x)
    SELECT id, check_kind, CASE WHEN check_kind IS NULL THEN NULL WHEN shape = 0 THEN 'status' WHEN shape = 1 THEN 'kind' ELSE 'qty' END AS check_column,
      CASE shape WHEN 0 THEN concat(s, '|it''s') WHEN 1 THEN 'a|b' WHEN 2 THEN CASE WHEN CAST(n AS VARCHAR) <= '3' THEN concat(n, '|3') ELSE concat('3|', n) END END AS literals,
      CASE WHEN check_kind = 'range' THEN CASE shape WHEN 5 THEN n + 1 WHEN 9 THEN -n - 1000000 ELSE n END END AS low,
      CASE WHEN check_kind = 'range' THEN CASE shape WHEN 3 THEN 50 WHEN 4 THEN 59 WHEN 5 THEN n + 1000001 ELSE -n END END AS high FROM k""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.recognize_checks(frame(spark, sf_dir, "check_texts")).select(
        "id", "check_kind", "check_column", F.array_join("literals", "|").alias("literals"), "low", "high"
    )


# Ten parts in a row are the tables of one application, with keys between them.
define(
    "schema_keys",
    """
SELECT concat('app-', CAST(floor(p_partkey / 10) AS BIGINT)) AS app_id, concat('t', j) AS table_id, concat('t', CAST(floor(j / 2) AS BIGINT)) AS referenced_table, concat('t', j, '.up') AS columns, p_size % 4 < 3 AS nullable
FROM (SELECT *, p_partkey % 10 AS j FROM {part}) p WHERE j > 0
UNION ALL SELECT concat('app-', CAST(floor(p_partkey / 10) AS BIGINT)), concat('t', p_partkey % 10), concat('t', p_partkey % 10), concat('t', p_partkey % 10, '.self'), p_size % 2 = 0 FROM {part} WHERE p_size % 11 = 0
UNION ALL SELECT concat('app-', CAST(floor(p_partkey / 10) AS BIGINT)), 't1', 't5', 't1.down', p_size > 10 FROM {part} WHERE p_partkey % 10 = 1 AND p_size < 25
""",
)
define("schema_tables", "SELECT concat('app-', CAST(floor(p_partkey / 10) AS BIGINT)) AS app_id, concat('t', p_partkey % 10) AS table_id FROM {part}")
_ORDER = """sk AS (SELECT * FROM schema_keys WHERE (app_id, referenced_table) IN (SELECT app_id, table_id FROM schema_tables)),
    rc(app_id, a, b) AS (SELECT app_id, table_id, referenced_table FROM sk UNION SELECT rc.app_id, a, referenced_table FROM rc JOIN sk ON sk.app_id = rc.app_id AND sk.table_id = rc.b),
    mem AS (SELECT x.app_id, x.a AS table_id, max(x.b) AS component FROM rc x WHERE (x.app_id, x.b, x.a) IN (SELECT app_id, a, b FROM rc) GROUP BY ALL),
    ins AS (SELECT k.*, m.component FROM sk k JOIN mem m ON m.app_id = k.app_id AND m.table_id = k.table_id JOIN mem p ON p.app_id = k.app_id AND p.table_id = k.referenced_table WHERE m.component = p.component),
    vd AS (SELECT app_id, component, bool_and(nullable) AS kept FROM ins GROUP BY ALL),
    lost AS (SELECT m.* FROM mem m JOIN vd USING (app_id, component) WHERE NOT kept),
    rem AS (SELECT DISTINCT app_id, table_id, referenced_table FROM sk k WHERE table_id <> referenced_table AND (app_id, table_id, referenced_table) NOT IN (SELECT app_id, table_id, referenced_table FROM ins)
      AND (app_id, table_id) NOT IN (SELECT app_id, table_id FROM lost) AND (app_id, referenced_table) NOT IN (SELECT app_id, table_id FROM lost))"""


def _order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keys = frame(spark, sf_dir, "schema_keys")
    columns = keys.select("app_id", F.col("columns").alias("column_id"), "nullable")
    listed = keys.withColumn("columns", F.array("columns"))
    return generate.table_order(frame(spark, sf_dir, "schema_tables"), listed, columns)


@query(
    "g11_table_order",
    inputs="schema_keys schema_tables",
    sql=f"""WITH RECURSIVE {_ORDER}, lv(app_id, table_id, level) AS (SELECT app_id, table_id, 0 FROM schema_tables WHERE (app_id, table_id) NOT IN (SELECT app_id, table_id FROM lost)
      UNION SELECT l.app_id, r.table_id, l.level + 1 FROM lv l JOIN rem r ON r.app_id = l.app_id AND r.referenced_table = l.table_id),
    mx AS (SELECT app_id, table_id, max(level) AS level FROM lv GROUP BY ALL)
    SELECT app_id, table_id, level, row_number() OVER (PARTITION BY app_id ORDER BY level, table_id) AS position FROM mx""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order(spark, sf_dir)[0]


@query(
    "g11_deferred_columns",
    inputs="schema_keys schema_tables",
    sql=f"""WITH RECURSIVE {_ORDER} SELECT app_id, 'deferred' AS kind, i.columns AS what FROM ins i JOIN vd USING (app_id, component) WHERE kept
    UNION ALL SELECT app_id, 'fk_cycle', concat('non-null foreign key cycle: ', string_agg(table_id, ', ' ORDER BY table_id)) FROM lost GROUP BY app_id, component""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    _placed, deferred, reasons = _order(spark, sf_dir)
    return deferred.select("app_id", F.lit("deferred").alias("kind"), F.col("column_id").alias("what")).unionByName(
        reasons.select("app_id", "kind", F.col("reason").alias("what"))
    )


@query(
    "g12_fill_deferred_keys",
    sql=f"""WITH p AS (SELECT s_suppkey AS key_value, row_number() OVER (ORDER BY s_suppkey) - 1 AS pool_index FROM supplier)
    SELECT c_custkey, c_name, key_value AS supplier_id FROM customer JOIN p ON p.pool_index = {_hash("supplier_id", "c_custkey")} % (SELECT count(*) FROM p)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.lit(None).cast("bigint").alias("supplier_id")
    )
    pool = key_pool(table(spark, sf_dir, "supplier"), "s_suppkey")
    return generate.fill_deferred(made, "c_custkey", "supplier_id", _stream("supplier_id"), pool)


@query(
    "g13_unique_columns",
    inputs="phys_columns phys_constraints",
    sql=f"WITH {_UNIQUE} SELECT * FROM un",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.unique_columns(*_plan_inputs(spark, sf_dir))[0]


def _storefront(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    counts = [table(spark, sf_dir, t).count() for t in ("supplier", "customer", "part", "orders", "lineitem")]
    return generate.storefront(spark, *counts)


_N = "(SELECT count(*) FROM {0})"


@query(
    "g14_arithmetic_dataset",
    sql=f"""SELECT i AS id, (i - 1) % {_N.format("supplier")} + 1 AS tenant_id, (i - 1) % {_N.format("customer")} + 1 AS user_id,
      ['paid', 'paid', 'paid', 'paid', 'paid', 'paid', 'pending', 'pending', 'shipped', 'cancelled'][((i - 1) // {_N.format("supplier")}) % 10 + 1] AS status, 1000 + i % 500 * 13 AS total_cents,
      strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(i * 7919 % {_N.format("orders")}), '%Y-%m-%d %H:%M:%S') AS created_at FROM range(1, {_N.format("orders")} + 1) t(i)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _storefront(spark, sf_dir)["orders"]
    return orders.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    "g14_arithmetic_items",
    sql=f"""SELECT i AS id, (i - 1) % {_N.format("orders")} + 1 AS order_id, (i - 1) % {_N.format("part")} + 1 AS product_id, 1 + i % 4 AS quantity, 500 + i % 400 * 7 AS unit_price_cents
    FROM range(1, {_N.format("lineitem")} + 1) t(i)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _storefront(spark, sf_dir)["order_items"]


@query(
    "g15_orphans",
    sql="""SELECT 'lineitem.l_orderkey' AS reference, l_orderkey AS value, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 400000) GROUP BY 2
    UNION ALL SELECT 'orders.o_custkey', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 2""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    kept = orders.where("o_totalprice < 400000")
    paying = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    lines = generate.orphans(lineitem, "l_orderkey", kept, "o_orderkey")
    heads = generate.orphans(orders, "o_custkey", paying, "c_custkey")
    return lines.withColumn("reference", F.lit("lineitem.l_orderkey")).unionByName(
        heads.withColumn("reference", F.lit("orders.o_custkey"))
    )


@query(
    "g15_duplicates",
    sql="SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "g15_check_violations",
    sql="""SELECT 'quantity in range' AS rule, count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 45)) AS rows FROM lineitem
    UNION ALL SELECT 'flag listed', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem UNION ALL SELECT 'ship date set', count(*) FILTER (WHERE l_shipdate IS NULL) FROM lineitem""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "quantity in range": F.col("l_quantity").between(1, 45),
        "flag listed": F.col("l_returnflag").isin("A", "N"),
        "ship date set": F.col("l_shipdate").isNotNull(),
    }
    return generate.violations(table(spark, sf_dir, "lineitem"), rules)


def _specs(accounts: int, orders: int) -> list[TableSpec]:
    return [
        TableSpec(
            "accounts",
            accounts,
            (
                ColumnSpec("id", "bigint", "unique_sequential_int"),
                ColumnSpec("email", "text", "email_heuristic"),
                ColumnSpec("plan", "text", "check_recognized_set", literals=("free", "paid")),
                ColumnSpec("created_at", "timestamp", "timestamp_heuristic"),
            ),
        ),
        TableSpec(
            "orders",
            orders,
            (
                ColumnSpec("id", "bigint", "unique_sequential_int"),
                ColumnSpec("code", "text", "unique_sequential_text"),
                ColumnSpec("account_id", "bigint", "foreign_key", parent="accounts", parent_key="id"),
                ColumnSpec("quantity", "integer", "check_recognized_range", low=1, high=9),
                ColumnSpec("open", "boolean", "boolean"),
            ),
        ),
    ]


@query(
    "g15_same_rows",
    sql="SELECT count(*) AS rows, 0 AS only_first, 0 AS only_second FROM orders",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").count()
    pool = key_pool(table(spark, sf_dir, "customer"), "c_custkey")
    spec = _specs(0, rows)[1]
    pools = {"accounts.id": pool}
    first = generate.generate_rows(spark, spec, rows, SEED, EPOCH, pools)
    second = generate.generate_rows(spark, spec, rows, SEED, EPOCH, {"accounts.id": pool.repartition(3)})
    sides = first.withColumn("w", F.lit(1)).unionByName(second.repartition(5).withColumn("w", F.lit(-1)))
    counts = sides.groupBy(*first.columns).agg(F.sum("w").alias("w"), F.count_if(F.col("w") > 0).alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("w"))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.when(F.col("w") < 0, -F.col("w"))), F.lit(0)).alias("only_second"),
    )


@query(
    "g01_load_dataset",
    sql="""SELECT 'accounts' AS table_id, count(*) // 2 AS existing, count(*) - count(*) // 2 AS added, count(*) AS rows, count(*) AS distinct_ids, 0 AS orphans FROM customer
    UNION ALL SELECT 'orders', count(*) // 3, count(*) - count(*) // 3, count(*), count(*), 0 FROM orders""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts, orders = table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "orders").count()
    root = new_path(spark, "dataset")
    generate.load_dataset(spark, _specs(accounts // 2, orders // 3), root, SEED, EPOCH)
    report = generate.load_dataset(spark, _specs(accounts, orders), root, SEED, EPOCH)
    made = {name: spark.read.parquet(f"{root}/{name}") for name in report}
    lost = generate.orphans(made["orders"], "account_id", made["accounts"], "id")
    missing = {"accounts": F.lit(0), "orders": F.lit(lost.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])}
    parts = [
        df.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("distinct_ids")).select(
            F.lit(name).alias("table_id"),
            F.lit(report[name][0]).alias("existing"),
            F.lit(report[name][1]).alias("added"),
            "rows",
            "distinct_ids",
            missing[name].cast("long").alias("orphans"),
        )
        for name, df in made.items()
    ]
    return parts[0].unionByName(parts[1])
