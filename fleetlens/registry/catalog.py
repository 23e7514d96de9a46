"""Catalog, reconciliation, graph, rule and candidate queries.

Every supplier is one application; its line items describe tables, columns, keys, indexes
and relationships, so the fleet grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.identity import finding_identity
from fleetlens.operators import candidates, reconcile, refresh, rules, schema_graph, treatment, workload
from fleetlens.registry.base import query
from fleetlens.registry.inputs import define, frame, trie_sql
from fleetlens.registry.workload import captured, captured_queries
from fleetlens.sources.scratch import new_path

define(
    "catalog_lines",
    """
SELECT concat('app-', l_suppkey) AS app_id, concat('public.t', l_orderkey % 97) AS table_id, concat('t', l_orderkey % 97) AS table_name,
  CASE l_partkey % 6 WHEN 5 THEN 'tenant_id' ELSE concat('c', l_partkey % 6) END AS name, l_partkey % 6 AS ordinal,
  l_linenumber AS ln, l_orderkey * 10 + l_linenumber AS place, l_quantity AS qty, l_discount AS disc, l_tax AS tax,
  l_returnflag AS rf, l_linestatus AS ls, l_suppkey AS app_no, l_orderkey, l_partkey
FROM {lineitem}
""",
)
_COLUMNS = """
SELECT app_id, table_id, table_name, concat(table_id, '.', name) AS column_id, name, min(ordinal) AS ordinal,
  CASE min(ln) WHEN 1 THEN 'integer' WHEN 2 THEN 'bigint' WHEN 3 THEN 'character varying(40)' WHEN 4 THEN 'timestamp without time zone'
    WHEN 5 THEN 'boolean' WHEN 6 THEN 'numeric(12,2)' ELSE 'jsonb' END AS data_type, max(disc) > 0.05 AS nullable,
  CASE WHEN name = 'c0' AND min(qty) < 10 THEN 'nextval(''s'')' WHEN min(qty) > 45 THEN '0' END AS default_expression
FROM {catalog_lines} WHERE %s GROUP BY app_id, table_id, table_name, name
"""
# The built texts group by the numbers that identities are made of, one number to one text, and
# write the texts after the shuffle.
_GROUPS = "SELECT app_no, l_orderkey %% 97 AS t, ordinal, %s FROM {catalog_lines} WHERE %s GROUP BY app_no, l_orderkey %% 97, ordinal"
_LINED_GROUPS = _GROUPS.replace("AS t, ordinal,", "AS t, ordinal, ln,") + ", ln"
_TEXTS = """SELECT *, concat('app-', app_no) AS app_id, concat('public.t', t) AS table_id, concat('t', t) AS table_name,
  CASE ordinal WHEN 5 THEN 'tenant_id' ELSE concat('c', ordinal) END AS name FROM (%s) g"""
_BUILT_COLUMNS = """
SELECT app_id, table_id, table_name, concat(table_id, '.', name) AS column_id, name, ordinal,
  CASE ln WHEN 1 THEN 'integer' WHEN 2 THEN 'bigint' WHEN 3 THEN 'character varying(40)' WHEN 4 THEN 'timestamp without time zone'
    WHEN 5 THEN 'boolean' WHEN 6 THEN 'numeric(12,2)' ELSE 'jsonb' END AS data_type, disc > 0.05 AS nullable,
  CASE WHEN name = 'c0' AND qty < 10 THEN 'nextval(''s'')' WHEN qty > 45 THEN '0' END AS default_expression
FROM (%s) c
"""


def _built_columns(where: str) -> str:
    return _BUILT_COLUMNS % (_TEXTS % (_GROUPS % ("min(ln) AS ln, max(disc) AS disc, min(qty) AS qty", where)))


define("phys_columns", _COLUMNS % "rf <> 'R'", snapshot=True, built=_built_columns("rf <> 'R'"))
define("orm_columns", _COLUMNS % "ls = 'O'", snapshot=True, built=_built_columns("ls = 'O'"))
_TABLES = "SELECT DISTINCT app_id, table_id, 'public' AS schema_name, table_name AS name FROM {%s}"
_BUILT_TABLES = """SELECT concat('app-', app_no) AS app_id, concat('public.t', t) AS table_id, 'public' AS schema_name, concat('t', t) AS name
FROM (SELECT DISTINCT app_no, l_orderkey %% 97 AS t FROM {catalog_lines} WHERE %s) g"""
define("phys_tables", _TABLES % "phys_columns", snapshot=True, built=_BUILT_TABLES % "rf <> 'R'")
define("orm_tables", _TABLES % "orm_columns", snapshot=True, built=_BUILT_TABLES % "ls = 'O'")
_KEYS = """SELECT app_id, table_id, concat('pk_', table_name) AS name, 'primary_key' AS kind, column_id AS columns,
  CAST(NULL AS STRING) AS referenced_table, CAST(NULL AS STRING) AS referenced_columns, CAST(NULL AS STRING) AS on_delete,
  CAST(NULL AS STRING) AS expression, 0 AS ordinal FROM {%s} WHERE name = 'c0'"""
_FOREIGN = """SELECT app_id, table_id, concat('fk_', table_name, '_', name, '_t', ln) AS name, 'foreign_key' AS kind,
  CASE WHEN min(qty) > 45 THEN concat(table_id, '.', name, ',', table_id, '.c1') ELSE concat(table_id, '.', name) END AS columns,
  concat('public.t', ln) AS referenced_table,
  CASE WHEN min(qty) > 45 THEN concat('public.t', ln, '.c0,public.t', ln, '.c1') ELSE concat('public.t', ln, '.c0') END AS referenced_columns,
  CASE WHEN min(tax) < 0.02 THEN 'cascade' WHEN min(tax) > 0.06 THEN 'set_null' END AS on_delete,
  CAST(NULL AS STRING) AS expression, min(place) AS ordinal
FROM {catalog_lines} WHERE %s GROUP BY app_id, table_id, table_name, name, ln"""
_NO_TEXT = "CAST(NULL AS STRING)"
_BUILT_FOREIGN = """SELECT app_id, table_id, concat('fk_', table_name, '_', name, '_t', ln) AS name, 'foreign_key' AS kind,
  CASE WHEN qty > 45 THEN concat(table_id, '.', name, ',', table_id, '.c1') ELSE concat(table_id, '.', name) END AS columns,
  concat('public.t', ln) AS referenced_table,
  CASE WHEN qty > 45 THEN concat('public.t', ln, '.c0,public.t', ln, '.c1') ELSE concat('public.t', ln, '.c0') END AS referenced_columns,
  CASE WHEN tax < 0.02 THEN 'cascade' WHEN tax > 0.06 THEN 'set_null' END AS on_delete,
  CAST(NULL AS STRING) AS expression, place AS ordinal
FROM (%s) f"""


def _built_foreign(where: str) -> str:
    return _BUILT_FOREIGN % (
        _TEXTS % (_LINED_GROUPS % ("min(qty) AS qty, min(tax) AS tax, min(place) AS place", where))
    )


def _built_unary(prefix: str, kind: str, columns: str, expression: str, where: str) -> str:
    """Keys and checks of one column."""
    return f"""SELECT app_id, table_id, concat('{prefix}_', table_name, '_', name), '{kind}', {columns}, {_NO_TEXT}, {_NO_TEXT}, {_NO_TEXT}, {expression}, place
FROM ({_TEXTS % (_GROUPS % ("min(place) AS place", where))}) u"""


define(
    "phys_constraints",
    _KEYS % "phys_columns"
    + " UNION ALL "
    + _FOREIGN % "rf = 'N'"
    + """
UNION ALL SELECT app_id, table_id, concat('uq_', table_name, '_', name), 'unique', concat(table_id, '.', name), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CAST(NULL AS STRING), CAST(NULL AS STRING), min(place) FROM {catalog_lines} WHERE rf = 'A' AND ln = 1 GROUP BY app_id, table_id, table_name, name
UNION ALL SELECT app_id, table_id, concat('ck_', table_name, '_', name), 'check', '', CAST(NULL AS STRING), CAST(NULL AS STRING),
  CAST(NULL AS STRING), concat('(', name, ' >= 0)'), min(place) FROM {catalog_lines} WHERE rf = 'A' AND ln = 2 GROUP BY app_id, table_id, table_name, name
""",
    snapshot=True,
    built=" UNION ALL ".join(
        [
            _KEYS % "phys_columns",
            _built_foreign("rf = 'N'"),
            _built_unary("uq", "unique", "concat(table_id, '.', name)", _NO_TEXT, "rf = 'A' AND ln = 1"),
            _built_unary("ck", "check", "''", "concat('(', name, ' >= 0)')", "rf = 'A' AND ln = 2"),
        ]
    ),
)
define(
    "orm_constraints",
    _KEYS % "orm_columns" + " UNION ALL " + _FOREIGN % "ls = 'O' AND rf = 'R'",
    snapshot=True,
    built=_KEYS % "orm_columns" + " UNION ALL " + _built_foreign("ls = 'O' AND rf = 'R'"),
)
define(
    "phys_indexes",
    """
SELECT app_id, table_id, concat('ix_', table_name, '_', name, '_', ln) AS name, CASE WHEN ln = 7 THEN 'hash' ELSE 'btree' END AS method,
  CASE WHEN min(qty) < 3 THEN 'expr' WHEN min(qty) > 40 THEN 'two' ELSE 'one' END AS shape, concat(table_id, '.', name) AS column_id,
  CASE WHEN max(disc) > 0.08 THEN 'desc' ELSE 'asc' END AS direction, CASE WHEN max(qty) > 48 THEN 'c1 > 0' END AS predicate, min(tax) < 0.01 AS is_unique
FROM {catalog_lines} WHERE tax < 0.03 GROUP BY app_id, table_id, table_name, name, ln
""",
    snapshot=True,
    built="""
SELECT app_id, table_id, concat('ix_', table_name, '_', name, '_', ln) AS name, CASE WHEN ln = 7 THEN 'hash' ELSE 'btree' END AS method,
  CASE WHEN least_qty < 3 THEN 'expr' WHEN least_qty > 40 THEN 'two' ELSE 'one' END AS shape, concat(table_id, '.', name) AS column_id,
  CASE WHEN disc > 0.08 THEN 'desc' ELSE 'asc' END AS direction, CASE WHEN most_qty > 48 THEN 'c1 > 0' END AS predicate, tax < 0.01 AS is_unique
FROM (%s) i
"""
    % (
        _TEXTS
        % (
            _LINED_GROUPS
            % ("min(qty) AS least_qty, max(qty) AS most_qty, max(disc) AS disc, min(tax) AS tax", "tax < 0.03")
        )
    ),
)
define(
    "phys_unsupported",
    """
SELECT app_id, CASE WHEN ln = 7 THEN 'op.create_index has a non-literal argument' ELSE 'op.execute payload not statically interpreted' END AS reason
FROM {catalog_lines} WHERE rf = 'R' AND ls = 'O' AND qty > 49
""",
)
define(
    "relationships",
    """
SELECT app_id, concat('rel_', ln, '_', ordinal) AS name, table_id AS source_table, concat('public.t', ln) AS target_table,
  CASE WHEN ordinal < 4 THEN 'many_to_one' WHEN ordinal = 4 THEN 'one_to_many' ELSE 'many_to_many' END AS cardinality,
  CASE WHEN ordinal = 5 THEN concat('public.t', app_no % 97) END AS secondary_table, min(place) AS ordinal
FROM {catalog_lines} WHERE ls = 'F' GROUP BY app_id, table_id, ln, ordinal, app_no
""",
    snapshot=True,
    built="""
SELECT concat('app-', app_no) AS app_id, concat('rel_', ln, '_', ordinal) AS name, concat('public.t', t) AS source_table, concat('public.t', ln) AS target_table,
  CASE WHEN ordinal < 4 THEN 'many_to_one' WHEN ordinal = 4 THEN 'one_to_many' ELSE 'many_to_many' END AS cardinality,
  CASE WHEN ordinal = 5 THEN concat('public.t', app_no %% 97) END AS secondary_table, place AS ordinal
FROM (%s) r
"""
    % (_LINED_GROUPS % ("min(place) AS place", "ls = 'F'")),
)
define(
    "app_context",
    """
SELECT concat('app-', s_suppkey) AS app_id, CASE s_nationkey % 4 WHEN 0 THEN 'shared_schema_tenant_id' WHEN 1 THEN 'single_tenant'
  WHEN 2 THEN 'unknown' END AS tenant_model FROM {supplier}
""",
)
_FIRST = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY app_id, {s}, {t} ORDER BY ordinal, name) AS rn FROM {f} WHERE {w}) z WHERE rn = 1)"
_FK_PAIRS = _FIRST.format(s="table_id", t="referenced_table", f="phys_constraints", w="kind = 'foreign_key'")
_HOLDING = _FIRST.format(s="source_table", t="target_table", f="relationships", w="cardinality = 'many_to_one'")
_PK = "(SELECT app_id, columns AS column_id FROM phys_constraints WHERE kind = 'primary_key' UNION SELECT app_id, columns FROM orm_constraints WHERE kind = 'primary_key')"


def _arrays(df: DataFrame) -> DataFrame:
    def listed(name: str):
        return F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, ","))

    return (
        df.withColumn("columns", listed("columns"))
        .withColumn("referenced_columns", listed("referenced_columns"))
        .withColumn("on_update", F.lit(None).cast("string"))
    )


def catalog(spark: SparkSession, sf_dir: str, side: str) -> dict[str, DataFrame]:
    return {
        "tables": frame(spark, sf_dir, f"{side}_tables"),
        "columns": frame(spark, sf_dir, f"{side}_columns"),
        "constraints": _arrays(frame(spark, sf_dir, f"{side}_constraints")),
    }


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = "IF(shape = 'expr', struct(CAST(NULL AS STRING) AS column, 'lower(c1)' AS expression, direction AS direction), struct(column_id AS column, CAST(NULL AS STRING) AS expression, direction AS direction))"
    second = "struct(concat(table_id, '.c1') AS column, CAST(NULL AS STRING) AS expression, 'asc' AS direction)"
    return frame(spark, sf_dir, "phys_indexes").withColumn(
        "keys", F.expr(f"IF(shape = 'two', array({first}, {second}), array({first}))")
    )


_TABLE_DIFF = f"""SELECT app_id, '{reconcile.MISSING}' AS kind, table_id AS objects, concat(o.name, ': declared by the ORM but not created by any migration') AS summary
      FROM orm_tables o WHERE NOT EXISTS (SELECT 1 FROM phys_tables p WHERE p.app_id = o.app_id AND p.table_id = o.table_id)
    UNION ALL SELECT app_id, '{reconcile.UNDECLARED}', table_id, concat(p.name, ': created by a migration but not declared by any ORM model')
      FROM phys_tables p WHERE NOT EXISTS (SELECT 1 FROM orm_tables o WHERE p.app_id = o.app_id AND p.table_id = o.table_id)"""
_COLUMN_DIFF = f"""SELECT app_id, kind, column_id AS objects, summary FROM (SELECT app_id, column_id,
      CASE WHEN p.column_id IS NULL THEN '{reconcile.MISSING}' WHEN o.column_id IS NULL THEN '{reconcile.UNDECLARED}'
        WHEN o.nullable <> p.nullable AND (app_id, column_id) NOT IN (SELECT app_id, column_id FROM {_PK} k) THEN '{reconcile.NULLABILITY}' END AS kind,
      CASE WHEN p.column_id IS NULL THEN concat(o.table_name, '.', o.name, ': declared by the ORM but not created by any migration')
        WHEN o.column_id IS NULL THEN concat(p.table_name, '.', p.name, ': created by a migration but not declared by any ORM model')
        ELSE concat(o.table_name, '.', o.name, ': the ORM declares nullable=', CASE WHEN o.nullable THEN 'True' ELSE 'False' END,
          ', the migration creates nullable=', CASE WHEN p.nullable THEN 'True' ELSE 'False' END) END AS summary
    FROM orm_columns o FULL JOIN phys_columns p USING (app_id, column_id)
    WHERE (app_id, coalesce(o.table_id, p.table_id)) IN (SELECT app_id, table_id FROM phys_tables INTERSECT SELECT app_id, table_id FROM orm_tables)) d WHERE kind IS NOT NULL"""
_RELATION_DIFF = f"""SELECT r.app_id, '{reconcile.DECLARED_ONLY}' AS kind, concat(r.source_table, ',', r.target_table) AS objects,
      concat(r.name, ': the ORM declares a relationship from ', substr(r.source_table, 8), ' to ', substr(r.target_table, 8), ', but no physical foreign key backs it') AS summary, r.ordinal
      FROM {_HOLDING} r LEFT JOIN {_FK_PAIRS} f ON f.app_id = r.app_id AND f.table_id = r.source_table AND f.referenced_table = r.target_table WHERE f.app_id IS NULL
    UNION ALL SELECT f.app_id, '{reconcile.PHYSICAL_ONLY}', concat(f.table_id, ',', f.referenced_table),
      concat(f.name, ': a physical foreign key exists from ', substr(f.table_id, 8), ' to ', substr(f.referenced_table, 8), ', but no ORM relationship declares it'), f.ordinal
      FROM {_FK_PAIRS} f LEFT JOIN {_HOLDING} r ON f.app_id = r.app_id AND f.table_id = r.source_table AND f.referenced_table = r.target_table WHERE r.app_id IS NULL"""
_OBSERVED = f"""obs AS (SELECT app_id, kind, objects, summary FROM ({_TABLE_DIFF}) a UNION ALL SELECT * FROM ({_COLUMN_DIFF}) b
    UNION ALL SELECT app_id, kind, objects, summary FROM ({_RELATION_DIFF}) c),
    obe AS (SELECT *, concat('["reconciliation","', kind, '",["', replace(objects, ',', '","'), '"]]') AS evidence_id FROM obs)"""
_ALL_INPUTS = "phys_tables orm_tables phys_columns orm_columns phys_constraints orm_constraints relationships"


def _flat(observations: DataFrame) -> DataFrame:
    return observations.withColumn("objects", F.array_join("objects", ","))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(
        catalog(spark, sf_dir, "phys"),
        catalog(spark, sf_dir, "orm"),
        frame(spark, sf_dir, "relationships"),
    )


@query("k01_reconcile_tables", inputs="phys_tables orm_tables", sql=_TABLE_DIFF)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.reconcile_tables(
        frame(spark, sf_dir, "phys_tables"), frame(spark, sf_dir, "orm_tables")
    )
    return _flat(found)


@query("k02_reconcile_columns", inputs=_ALL_INPUTS, sql=_COLUMN_DIFF)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = catalog(spark, sf_dir, "phys"), catalog(spark, sf_dir, "orm")
    keys = reconcile.key_columns(p["constraints"], o["constraints"])
    return _flat(
        reconcile.reconcile_columns(p["columns"], o["columns"], p["tables"], o["tables"], keys)
    )


@query("k03_reconcile_relationships", inputs=_ALL_INPUTS, sql=_RELATION_DIFF)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    constraints = catalog(spark, sf_dir, "phys")["constraints"]
    return _flat(
        reconcile.reconcile_relationships(constraints, frame(spark, sf_dir, "relationships"))
    )


@query("k04_reconcile", inputs=_ALL_INPUTS, sql=f"WITH {_OBSERVED} SELECT * FROM obe")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(observations(spark, sf_dir))


@query(
    "k05_evidence_for_object",
    inputs=_ALL_INPUTS,
    sql=f"WITH {_OBSERVED} SELECT DISTINCT app_id, unnest(string_split(objects, ',')) AS object_id, evidence_id FROM obe",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.evidence_for_objects(observations(spark, sf_dir))


# Documents stand in for source files: one application per language and source.
@query(
    "k06_stale_evidence",
    sql="""WITH f AS (SELECT doc_id, concat(lang, '/', source) AS app_id, concat('app/doc_', doc_id, '.py') AS path, concat('sha256:', sha256(text)) AS h FROM documents)
    SELECT app_id, path, concat('ev-', doc_id) AS evidence_id, concat('sha256:', sha256(CAST(quality AS VARCHAR))) AS content_hash, h AS current_hash
    FROM f JOIN labels USING (doc_id) WHERE quality = 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frame(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "lang", "source").alias("app_id"),
        F.concat(F.lit("app/doc_"), "doc_id", F.lit(".py")).alias("path"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"),
    )
    # A good document was cited as it is now, a bad one with an older hash.
    labels = frame(spark, sf_dir, "labels")
    evidence = files.join(labels, "doc_id").select(
        "app_id",
        "path",
        F.concat(F.lit("ev-"), "doc_id").alias("evidence_id"),
        F.when(F.col("quality") == 1, F.col("content_hash"))
        .otherwise(F.concat(F.lit("sha256:"), F.sha2(F.col("quality").cast("string"), 256)))
        .alias("content_hash"),
    )
    return reconcile.stale_evidence(evidence, files.drop("doc_id"))


_MERGED = """mt AS (SELECT * FROM phys_tables UNION ALL SELECT * FROM orm_tables o WHERE (app_id, table_id) NOT IN (SELECT app_id, table_id FROM phys_tables)),
    mc AS (SELECT *, 'physical' AS side FROM phys_columns UNION ALL SELECT *, 'declared' FROM orm_columns WHERE (app_id, table_id) NOT IN (SELECT app_id, table_id FROM phys_tables))"""


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, o = catalog(spark, sf_dir, "phys"), catalog(spark, sf_dir, "orm")
    columns = reconcile.merge_columns(p["columns"], o["columns"], p["tables"])
    tables = p["tables"].unionByName(o["tables"].join(p["tables"], ["app_id", "table_id"], "left_anti"))
    return tables, columns


@query(
    "k07_merge_schemas",
    inputs=_ALL_INPUTS,
    sql=f"WITH {_MERGED} SELECT app_id, column_id, data_type, nullable, side FROM mc",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir)[1].select("app_id", "column_id", "data_type", "nullable", "side")


_TARGETS = """pt AS (SELECT app_id, columns AS column_id, arg_max(referenced_columns, (ordinal, name)) AS target FROM phys_constraints
      WHERE kind = 'foreign_key' AND NOT contains(columns, ',') GROUP BY ALL),
    ot AS (SELECT app_id, columns AS column_id, arg_max(referenced_columns, (ordinal, name)) AS target FROM orm_constraints
      WHERE kind = 'foreign_key' AND NOT contains(columns, ',') GROUP BY ALL)"""
_NODES = f"""{_MERGED}, {_TARGETS}, nd AS (SELECT DISTINCT app_id, concat('schema:', schema_name) AS node_id, 'schema' AS kind, schema_name AS label, '' AS attributes FROM mt
    UNION ALL SELECT app_id, concat('table:', table_id), 'table', name, concat('schema=', schema_name) FROM mt
    UNION ALL SELECT app_id, concat('column:', column_id), 'column', name, concat('data_type=', data_type, ';nullable=', nullable, CASE WHEN pt.target IS NULL AND ot.target IS NOT NULL THEN concat(';orm_fk_target=', ot.target) ELSE '' END,
      CASE WHEN pt.target IS NOT NULL THEN concat(';physical_fk_target=', pt.target) ELSE '' END, ';primary_key=', (app_id, column_id) IN (SELECT app_id, column_id FROM {_PK} k))
      FROM mc LEFT JOIN pt USING (app_id, column_id) LEFT JOIN ot USING (app_id, column_id))"""
_EDGES = f"""ed AS (SELECT app_id, concat('["edge","contains","schema:', schema_name, '","table:', table_id, '"]') AS edge_id, 'contains' AS kind, concat('schema:', schema_name) AS source, concat('table:', table_id) AS target, NULL AS label FROM mt
    UNION ALL SELECT app_id, concat('["edge","contains","table:', table_id, '","column:', column_id, '"]'), 'contains', concat('table:', table_id), concat('column:', column_id), NULL FROM mc
    UNION ALL SELECT app_id, concat('["edge","physical_foreign_key","', name, '","', table_id, '","', referenced_table, '"]'), 'physical_foreign_key', concat('table:', table_id), concat('table:', referenced_table), name FROM {_FK_PAIRS} f
    UNION ALL SELECT r.app_id, concat('["edge","orm_only_relationship","', r.name, '","', r.source_table, '","', r.target_table, '"]'), 'orm_only_relationship', concat('table:', r.source_table), concat('table:', r.target_table), r.name
      FROM {_HOLDING} r LEFT JOIN {_FK_PAIRS} f ON f.app_id = r.app_id AND f.table_id = r.source_table AND f.referenced_table = r.target_table WHERE f.app_id IS NULL
    UNION ALL SELECT app_id, concat('["edge","orm_only_relationship","', name, '","', source_table, '","', target_table, '"]'), 'orm_only_relationship', concat('table:', source_table), concat('table:', target_table), concat(name, ' (via ', substr(secondary_table, 8), ')')
      FROM relationships WHERE secondary_table IS NOT NULL)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables, columns = merged(spark, sf_dir)
    physical = catalog(spark, sf_dir, "phys")["constraints"]
    declared = catalog(spark, sf_dir, "orm")["constraints"]
    nodes = schema_graph.graph_nodes(columns, tables, physical, declared)
    edges = schema_graph.graph_edges(
        columns, tables, physical, frame(spark, sf_dir, "relationships")
    )
    return nodes, edges


def _attribute_text() -> object:
    entries = F.array_sort(F.map_entries("attributes"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query("k08_graph_nodes", inputs=_ALL_INPUTS, sql=f"WITH {_NODES} SELECT * FROM nd")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[0].withColumn("attributes", _attribute_text())


@query("k09_graph_edges", inputs=_ALL_INPUTS, sql=f"WITH {_MERGED}, {_EDGES} SELECT * FROM ed")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir)[1]


# A graph with more kinds: operations read and write the tables.
_WIDE_NODES = """SELECT app_id, node_id, CASE WHEN kind = 'table' AND label = 't96' THEN 'query' ELSE kind END AS kind FROM nd"""


@query(
    "k10_er_view",
    inputs=_ALL_INPUTS,
    sql=f"""WITH {_NODES}, {_EDGES}, n AS (SELECT * FROM ({_WIDE_NODES}) w WHERE kind IN ('schema', 'table', 'column', 'index'))
    SELECT e.app_id, e.edge_id, e.kind FROM ed e JOIN n s ON s.app_id = e.app_id AND s.node_id = e.source JOIN n t ON t.app_id = e.app_id AND t.node_id = e.target""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    mixed = nodes.withColumn(
        "kind", F.expr("IF(kind = 'table' AND label = 't96', 'query', kind)")
    )
    return schema_graph.er_view(mixed, edges)[1].select("app_id", "edge_id", "kind")


@query(
    "k11_graph_identity",
    inputs=_ALL_INPUTS,
    sql=f"""WITH {_NODES}, {_EDGES}, r AS (SELECT app_id, sha256(concat('{{"_row":"edge","edge_id":"', replace(edge_id, '"', '\\"'), '","kind":"', kind, '","label":', CASE WHEN label IS NULL THEN 'null' ELSE concat('"', label, '"') END,
      ',"source":"', source, '","target":"', target, '"}}')) AS g FROM ed
      UNION ALL SELECT app_id, sha256(concat('{{"_row":"node","attributes":[', CASE WHEN attributes <> '' THEN concat('{{"key":"', replace(replace(attributes, '=', '","value":"'), ';', '"}},{{"key":"'), '"}}') ELSE '' END,
      '],"kind":"', kind, '","label":"', label, '","node_id":"', node_id, '"}}')) FROM nd), {trie_sql("app_id")}
    SELECT app_id, concat('sha256:', x) AS identity FROM trie0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_graph.graph_identity(*graph(spark, sf_dir))


@query(
    "k12_graph_integrity",
    inputs=_ALL_INPUTS,
    sql=f"""WITH {_NODES}, {_EDGES}, n2 AS (SELECT app_id, node_id FROM nd UNION ALL SELECT app_id, concat('table:', table_id) FROM orm_tables WHERE name = 't1')
    SELECT app_id, 'graph node ids must be unique' AS problem, node_id AS id FROM n2 GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT app_id, 'graph edge ids must be unique', edge_id FROM ed GROUP BY app_id, edge_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT app_id, 'edge references an unknown node', id FROM (SELECT app_id, source AS id FROM ed UNION SELECT app_id, target FROM ed) e
      WHERE (app_id, id) NOT IN (SELECT app_id, node_id FROM n2)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    again = frame(spark, sf_dir, "orm_tables").where("name = 't1'").selectExpr(
        "app_id", "concat('table:', table_id) AS node_id"
    )
    return schema_graph.graph_integrity(nodes.select("app_id", "node_id").unionByName(again), edges)


@query(
    "k13_node_kinds_present",
    inputs=_ALL_INPUTS,
    sql=f"WITH {_NODES} SELECT DISTINCT app_id, kind FROM ({_WIDE_NODES}) w",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph(spark, sf_dir)[0].withColumn(
        "kind", F.expr("IF(kind = 'table' AND label = 't96', 'query', kind)")
    )
    return schema_graph.node_kinds_present(nodes)


def _q(expression: str) -> str:
    return f"""concat('"', regexp_extract({expression}, '[^.]*$'), '"')"""


_T = """concat('"public"."', substr({0}, 8), '"')"""


@query(
    "k14_catalog_ddl",
    inputs="phys_tables phys_columns phys_constraints phys_indexes",
    sql=f"""WITH b AS (SELECT app_id, table_id, string_agg(concat('"', name, '" ', data_type, CASE WHEN nullable THEN '' ELSE ' NOT NULL' END,
        CASE WHEN default_expression IS NULL OR starts_with(default_expression, 'nextval(') THEN '' ELSE concat(' DEFAULT ', default_expression) END), concat(',', chr(10), '    ') ORDER BY ordinal) AS body FROM phys_columns GROUP BY ALL),
    c AS (SELECT *, list_aggregate(list_transform(string_split(columns, ','), lambda x: {_q("x")}), 'string_agg', ', ') AS cl,
      list_aggregate(list_transform(string_split(referenced_columns, ','), lambda x: {_q("x")}), 'string_agg', ', ') AS rl FROM phys_constraints)
    SELECT app_id, 1 AS phase, table_id, t.name, concat('CREATE TABLE ', {_T.format("table_id")}, ' (', chr(10), '    ', body, chr(10), ');') AS ddl FROM phys_tables t JOIN b USING (app_id, table_id)
    UNION ALL SELECT app_id, CASE WHEN kind = 'foreign_key' THEN 3 ELSE 2 END, table_id, name, concat('ALTER TABLE ', {_T.format("table_id")}, ' ADD CONSTRAINT "', name, '" ',
      CASE kind WHEN 'primary_key' THEN concat('PRIMARY KEY (', cl, ')') WHEN 'unique' THEN concat('UNIQUE (', cl, ')') WHEN 'check' THEN concat('CHECK ', expression)
        ELSE concat('FOREIGN KEY (', cl, ') REFERENCES ', {_T.format("referenced_table")}, ' (', rl, ')', CASE on_delete WHEN 'cascade' THEN ' ON DELETE CASCADE' WHEN 'set_null' THEN ' ON DELETE SET NULL' ELSE '' END) END, ';') FROM c
    UNION ALL SELECT app_id, 4, table_id, name, concat('CREATE ', CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END, 'INDEX "', name, '" ON ', {_T.format("table_id")}, ' USING ', method, ' (',
      CASE WHEN shape = 'expr' THEN 'lower(c1)' ELSE {_q("column_id")} END, CASE WHEN direction = 'desc' THEN ' DESC' ELSE '' END, CASE WHEN shape = 'two' THEN ', "c1"' ELSE '' END, ')',
      CASE WHEN predicate IS NULL THEN '' ELSE concat(' WHERE ', predicate) END, ';') FROM phys_indexes""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog(spark, sf_dir, "phys")
    return schema_graph.catalog_ddl(
        p["columns"], p["tables"], p["constraints"], indexes(spark, sf_dir)
    )


@query(
    "k15_head_matched",
    sql="""SELECT o_custkey AS app_id, coalesce(CASE WHEN max(o_totalprice) > 200000 THEN max(o_orderkey) END = max(o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), max(o_orderkey) FILTER (WHERE o_orderstatus <> 'F') IS NULL) AS matched
    FROM orders GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = frame(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("app_id")).agg(
        F.expr("IF(max(o_totalprice) > 200000, max(o_orderkey), NULL)").alias("live_head"),
        F.expr("max(o_orderkey) FILTER (WHERE o_orderstatus <> 'F')").alias("expected_head"),
    )
    return reconcile.head_matched(apps).select("app_id", "matched")


@query(
    "k16_fk_column_pairs",
    inputs="phys_constraints orm_constraints",
    sql=f"WITH {_TARGETS} SELECT * FROM pt",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_graph.fk_column_pairs(catalog(spark, sf_dir, "phys")["constraints"])


# --- rules -----------------------------------------------------------------------------------

_RULE_INPUTS = f"{_ALL_INPUTS} phys_indexes phys_unsupported app_context"


def rule_context(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p, o = catalog(spark, sf_dir, "phys"), catalog(spark, sf_dir, "orm")
    return {
        "constraints": p["constraints"],
        "columns": p["columns"],
        "declared_columns": o["columns"],
        "indexes": indexes(spark, sf_dir),
        "unsupported": frame(spark, sf_dir, "phys_unsupported"),
        "relationships": frame(spark, sf_dir, "relationships"),
        "context": frame(spark, sf_dir, "app_context"),
    }


_UNINDEXED = """blind AS (SELECT DISTINCT app_id FROM phys_unsupported WHERE contains(reason, 'create_index')),
    cov AS (SELECT app_id, column_id FROM phys_indexes WHERE shape <> 'expr' UNION SELECT app_id, columns FROM phys_constraints WHERE kind IN ('primary_key', 'unique')),
    ufk AS (SELECT app_id, columns AS column_id, row_number() OVER (PARTITION BY app_id ORDER BY columns, ordinal, name) AS n FROM phys_constraints
      WHERE kind = 'foreign_key' AND NOT contains(columns, ',') AND (app_id, columns) NOT IN (SELECT app_id, column_id FROM cov) AND app_id NOT IN (SELECT app_id FROM blind)),
    uf AS (SELECT app_id, concat('IDX-', lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS id, 'workload.unindexed_foreign_key' AS rule, 'worth_evaluating' AS priority, 'query' AS category,
      concat(substr(column_id, 8), ' is a foreign key with no covering index; lookups and cascading operations on it scan the table.') AS statement, column_id AS affected_objects FROM ufk)"""
_ENFORCE = f"""rd AS ({_RELATION_DIFF}), en AS (SELECT r.*, CASE WHEN coalesce(tenant_model, 'unknown') = 'unknown' THEN false ELSE tenant_model <> 'single_tenant' END AS tenant
      FROM rd r LEFT JOIN app_context USING (app_id) WHERE kind = 'orm_only_relationship'),
    eo AS (SELECT *, row_number() OVER (PARTITION BY app_id, tenant ORDER BY ordinal, split_part(objects, ',', 1), split_part(objects, ',', 2)) AS n FROM en),
    ef AS (SELECT app_id, concat(CASE WHEN tenant THEN 'TENANT-' ELSE 'SCHEMA-' END, lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS id, 'schema.orm_relationship_without_physical_fk' AS rule,
      'required_for_correctness' AS priority, CASE WHEN tenant THEN 'tenancy' ELSE 'schema' END AS category, summary AS statement, objects AS affected_objects FROM eo)"""
_QUESTION = """qn AS (SELECT app_id, 'core_tenant_model' AS question, 'tenancy.confirm_isolation_model' AS rule FROM (SELECT DISTINCT app_id FROM phys_columns WHERE name = 'tenant_id' UNION SELECT app_id FROM orm_columns WHERE name = 'tenant_id') t
      WHERE app_id NOT IN (SELECT app_id FROM app_context WHERE coalesce(tenant_model, 'unknown') <> 'unknown'))"""
_SHOWN = ["app_id", "id", "rule", "priority", "category", "statement", "affected_objects"]


def _finding_rows(findings: DataFrame) -> DataFrame:
    return findings.select(*_SHOWN).withColumn("affected_objects", F.array_join("affected_objects", ","))


@query("r01_unindexed_foreign_keys", inputs=_RULE_INPUTS, sql=f"WITH {_UNINDEXED} SELECT * FROM uf")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding_rows(rules.unindexed_foreign_keys(rule_context(spark, sf_dir)).findings)


@query("r02_undeclared_physical_fk", inputs=_RULE_INPUTS, sql=f"WITH {_ENFORCE} SELECT * FROM ef")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finding_rows(rules.undeclared_physical_keys(rule_context(spark, sf_dir)).findings)


@query("r03_tenant_model_question", inputs=_RULE_INPUTS, sql=f"WITH {_QUESTION} SELECT * FROM qn")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.tenant_model_question(rule_context(spark, sf_dir)).questions


_RULES_SQL = f"""{_UNINDEXED}, {_ENFORCE}, {_QUESTION}, al AS (SELECT * FROM uf UNION ALL SELECT * FROM ef)"""


@query(
    "r04_run_rules",
    inputs=_RULE_INPUTS,
    sql=f"""WITH {_RULES_SQL} SELECT app_id, 'finding' AS part, id AS what, rule AS detail FROM al UNION ALL SELECT app_id, 'question', question, rule FROM qn
    UNION ALL SELECT app_id, 'reason', 'index-candidate analysis skipped', NULL FROM blind""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_rows(rules.run_rules(rule_context(spark, sf_dir)))


def _rule_rows(out: rules.RuleOutput) -> DataFrame:
    return (
        out.findings.selectExpr("app_id", "'finding' AS part", "id AS what", "rule AS detail")
        .unionByName(out.questions.selectExpr("app_id", "'question' AS part", "question AS what", "rule AS detail"))
        .unionByName(
            out.reasons.selectExpr(
                "app_id", "'reason' AS part", "split(reason, ':')[0] AS what", "CAST(NULL AS STRING) AS detail"
            )
        )
    )


# An earlier state is evaluated and stored first: some applications are missing and some know less.
@query(
    "r04_refreshed_rules",
    inputs=_RULE_INPUTS,
    sql=f"""WITH {_RULES_SQL} SELECT app_id, 'finding' AS part, id AS what, rule AS detail FROM al UNION ALL SELECT app_id, 'question', question, rule FROM qn
    UNION ALL SELECT app_id, 'reason', 'index-candidate analysis skipped', NULL FROM blind""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx, store = rule_context(spark, sf_dir), new_path(spark, "rule-results")
    missing, partial = F.col("app_id").endswith("7"), F.col("app_id").endswith("3")
    earlier = {
        name: df.where(~missing if name != "indexes" else ~(missing | partial)) for name, df in ctx.items()
    }
    refresh.refresh(earlier, store)
    refresh.refresh(ctx, store)
    return _rule_rows(refresh.stored_output(spark, store))


@query(
    "r05_headline_findings",
    inputs=_RULE_INPUTS,
    sql=f"""WITH {_RULES_SQL}, o AS (SELECT app_id, id, priority, row_number() OVER (PARTITION BY app_id ORDER BY CASE priority WHEN 'required_for_correctness' THEN 0 ELSE 3 END, id) AS rank,
      greatest(count(*) OVER (PARTITION BY app_id) - 3, 0) AS hidden FROM al) SELECT * FROM o WHERE rank <= 3""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.run_rules(rule_context(spark, sf_dir))
    return rules.headline_findings(out.findings).select("app_id", "id", "priority", "rank", "hidden")


@query(
    "r06_finding_counts",
    inputs=_RULE_INPUTS,
    sql=f"""WITH {_RULES_SQL}, x AS (SELECT app_id, priority AS w FROM al UNION ALL SELECT app_id, 'question' FROM qn)
    SELECT app_id, count(*) FILTER (WHERE w = 'required_for_correctness') AS required, count(*) FILTER (WHERE w = 'worth_evaluating') AS worth_evaluating,
      count(*) FILTER (WHERE w = 'question') AS questions FROM x GROUP BY ROLLUP (app_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.run_rules(rule_context(spark, sf_dir))
    return rules.finding_counts(out.findings, out.questions)


# Findings over line items: each order is one finding that cites evidence by line.
define(
    "cited_findings",
    """
SELECT concat('app-', o_custkey) AS app_id, concat('IDX-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS id,
  CASE WHEN o_orderkey % 50 = 7 THEN 'not a rule' ELSE 'workload.unindexed_foreign_key' END AS rule,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'verified_improvement' WHEN '2' THEN 'optional_hardening' ELSE 'worth_evaluating' END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'verified_in_fixture' ELSE 'eligible' END AS verification_state,
  CASE WHEN o_totalprice > 250000 THEN 'm' END AS measurement, CASE WHEN o_totalprice > 60000 THEN 'add_index' END AS change_kind,
  CASE WHEN o_totalprice < 30000 THEN 'core_retention' END AS blocking_question,
  CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('public.t', o_custkey % 9, ',public.t', o_orderkey % 9, ',public.t', o_custkey % 9) END AS affected_objects,
  concat('ev-', o_custkey, '-', o_orderkey % 4, ',ev-', o_custkey, '-', o_orderkey % 7, ',ev-none') AS evidence_refs, o_orderkey
FROM {orders}
""",
)
define(
    "cited_evidence",
    """
SELECT DISTINCT concat('app-', o_custkey) AS app_id, concat('ev-', o_custkey, '-', o_orderkey % 5) AS evidence_id,
  CASE WHEN o_orderkey % 5 <> 3 THEN concat('app/m', o_orderkey % 5, '.py') END AS path, CASE WHEN o_orderkey % 5 > 1 THEN o_orderkey % 5 END AS line
FROM {orders}
""",
)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "cited_findings")
    objects = F.when(F.col("affected_objects") == "", F.array().cast("array<string>")).otherwise(
        F.split("affected_objects", ",")
    )
    return df.withColumn("affected_objects", objects).withColumn(
        "evidence_refs", F.split("evidence_refs", ",")
    )


@query(
    "r07_finding_sources",
    inputs="cited_findings cited_evidence",
    sql="""WITH c AS (SELECT app_id, id, unnest(string_split(evidence_refs, ',')) AS evidence_id, generate_subscripts(string_split(evidence_refs, ','), 1) AS nth FROM cited_findings)
    SELECT app_id, id, string_agg(concat(path, CASE WHEN line IS NULL THEN '' ELSE concat(':', line) END), '|' ORDER BY nth) AS sources FROM c JOIN cited_evidence USING (app_id, evidence_id) WHERE path IS NOT NULL GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.finding_sources(findings(spark, sf_dir), frame(spark, sf_dir, "cited_evidence"))
    return found.withColumn("sources", F.array_join("sources", "|"))


@query(
    "r08_finding_validity",
    inputs="cited_findings",
    sql="""SELECT app_id, id, p AS problem FROM (SELECT app_id, id, unnest([
      CASE WHEN affected_objects = '' THEN 'a recommendation must name at least one affected object' END,
      CASE WHEN change_kind IS NULL AND blocking_question IS NULL THEN 'a recommendation must carry a proposed change or a blocking question' END,
      CASE WHEN verification_state = 'verified_in_fixture' AND measurement IS NULL THEN 'verified_in_fixture requires a fixture measurement to cite' END,
      CASE WHEN verification_state <> 'verified_in_fixture' AND measurement IS NOT NULL THEN 'a fixture measurement may only accompany verified_in_fixture' END,
      CASE WHEN verification_state <> 'verified_in_fixture' AND priority = 'verified_improvement' THEN 'verified_improvement requires verification_state verified_in_fixture' END,
      CASE WHEN rule = 'not a rule' THEN 'not a rule id' END]) AS p FROM cited_findings) x WHERE p IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.finding_validity(findings(spark, sf_dir))


@query(
    "r09_finding_identity",
    inputs="cited_findings",
    sql="""SELECT id, concat('["', rule, '",[', CASE WHEN affected_objects = '' THEN '' ELSE concat('"', list_aggregate(list_sort(list_distinct(string_split(affected_objects, ','))), 'string_agg', '","'), '"') END, ']]') AS identity FROM cited_findings""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select(
        "id", finding_identity("rule", "affected_objects").alias("identity")
    )


# --- treatment, routing, tenancy, candidates -------------------------------------------------

define(
    "op_runs",
    """
SELECT app_id, CASE WHEN CAST(substr(CAST(CAST(ts AS DATE) AS STRING), 9, 2) AS INT) % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS side,
  concat(node_id, '/', query_id) AS operation_id, duration_us, rowcount FROM {capture} WHERE NOT (query_id = 'view' AND rowcount < 60)
""",
)
define(
    "op_stats",
    "SELECT app_id, side, operation_id, count(*) AS query_count, nullif(CAST(sum(duration_us) AS BIGINT), 0) AS duration_us FROM {op_runs} GROUP BY app_id, side, operation_id",
)
define(
    "op_tests",
    """SELECT app_id, side, CASE WHEN app_id = 'app-3' THEN max(rowcount) + CASE WHEN side = 'baseline' THEN 1 ELSE 0 END ELSE 99 END AS selected_tests,
  CASE WHEN app_id = 'app-5' AND side = 'baseline' THEN 1 WHEN app_id = 'app-7' AND side = 'treatment' THEN 2 ELSE 0 END AS failed_tests FROM {op_runs} GROUP BY app_id, side""",
)


@query(
    "t01_compare_treatment",
    inputs="op_stats op_tests",
    sql="""WITH b AS (SELECT * FROM op_stats WHERE side = 'baseline'), t AS (SELECT * FROM op_stats WHERE side = 'treatment'),
    j AS (SELECT coalesce(b.app_id, t.app_id) AS app_id, coalesce(b.operation_id, t.operation_id) AS operation_id, b.query_count AS bc, t.query_count AS tc, b.duration_us AS bd, t.duration_us AS td
      FROM b FULL JOIN t ON b.app_id = t.app_id AND b.operation_id = t.operation_id),
    r AS (SELECT j.*, x.failed_tests AS bf, y.failed_tests AS tf, CASE WHEN bc IS NULL THEN 'operation absent from the baseline capture' WHEN tc IS NULL THEN 'operation absent from the treatment capture'
        WHEN x.failed_tests > 0 THEN 'baseline itself had failing tests; nothing to preserve' WHEN x.selected_tests <> y.selected_tests THEN 'baseline and treatment selected a different test set' END AS reason
      FROM j LEFT JOIN op_tests x ON x.app_id = j.app_id AND x.side = 'baseline' LEFT JOIN op_tests y ON y.app_id = j.app_id AND y.side = 'treatment')
    SELECT app_id, operation_id, coalesce(bc, 0) AS baseline_query_count, coalesce(tc, 0) AS treatment_query_count, bd AS baseline_duration_us, td AS treatment_duration_us, tc < bc AS amplification_reduced,
      reason AS unsupported_reason, reason IS NULL AND tf = 0 AS results_equivalent, coalesce(tc < bc, false) AND reason IS NULL AND tf = 0 AS verified FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, tests = frame(spark, sf_dir, "op_stats"), frame(spark, sf_dir, "op_tests")
    return treatment.compare_treatment(
        stats.where("side = 'baseline'"),
        stats.where("side = 'treatment'"),
        tests.where("side = 'baseline'"),
        tests.where("side = 'treatment'"),
    )


define(
    "requirements",
    """
SELECT app_id, site_symbol AS operation_label, min(rowcount) < 2 AS requires_read_after_write, CASE WHEN query_id = 'view' THEN 0 WHEN query_id = 'click' THEN 30 END AS lag_tolerance_seconds,
  min(sequence) AS ordinal FROM {capture} WHERE site_symbol <> 'handler_3' GROUP BY app_id, site_symbol, query_id
""",
)


@query(
    "t02_route_operations",
    inputs="capture requirements",
    sql="""WITH o AS (SELECT app_id, concat(node_id, '/', rowcount % 3) AS operation_id, bool_or(statement_class = 'write') AS writes, arg_min(site_symbol, sequence) FILTER (WHERE site_path IS NOT NULL) AS symbol FROM capture GROUP BY ALL),
    q AS (SELECT app_id, operation_label AS symbol, arg_min(requires_read_after_write, ordinal) AS raw, first(lag_tolerance_seconds ORDER BY ordinal) AS lag FROM requirements GROUP BY ALL)
    SELECT app_id, operation_id, symbol, CASE WHEN writes THEN 'primary_required' WHEN raw IS NULL THEN 'unknown_blocked' WHEN NOT raw THEN 'replica_eligible' WHEN coalesce(lag, 0) = 0 THEN 'primary_required' ELSE 'either' END AS verdict,
      CASE WHEN writes THEN 'writes at least one table; a write must reach the primary' WHEN raw IS NULL THEN 'no confirmed read-after-write requirement for this operation' WHEN NOT raw THEN 'confirmed read-only with no read-after-write requirement'
        WHEN coalesce(lag, 0) = 0 THEN 'confirmed to require immediate read-after-write consistency' ELSE concat('confirmed to tolerate ', lag, 's of replica lag') END AS reason
    FROM o LEFT JOIN q USING (app_id, symbol)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = captured(spark, sf_dir).withColumn(
        "node_id", F.concat("node_id", F.lit("/"), F.col("rowcount") % 3)
    )
    operations = workload.operation_rollup(log, captured_queries(spark, sf_dir)).select(
        "app_id",
        F.col("node_id").alias("operation_id"),
        "tables_written",
        F.col("entry_point.symbol").alias("symbol"),
    )
    routed = treatment.route_operations(operations, frame(spark, sf_dir, "requirements"))
    return routed.drop("tables_written")


# Each supplier's lines, by order group, are the predicates of one query.
define(
    "query_predicates",
    """
SELECT app_id, concat('q', l_orderkey % 50) AS query_id, ln * 100000000 + place AS ordinal, concat('public.t', l_orderkey % 3) AS table_id,
  concat('public.t', l_orderkey % 3, '.', name) AS column_id, CASE WHEN rf = 'R' THEN 'numeric_range' ELSE 'equality' END AS kind
FROM {catalog_lines}
""",
)


@query(
    "t03_tenant_enforcement_gaps",
    inputs="query_predicates phys_columns app_context",
    sql="""WITH u AS (SELECT DISTINCT app_id, query_id, table_id FROM query_predicates WHERE substr(query_id, 2) <> '7' AND app_id IN (SELECT app_id FROM app_context WHERE tenant_model = 'shared_schema_tenant_id'))
    SELECT app_id, query_id, table_id, concat(table_id, ' is tenant-scoped, but no recognized predicate on tenant_id was found in this query') AS reason FROM u
    WHERE (app_id, table_id) IN (SELECT app_id, table_id FROM phys_columns WHERE name = 'tenant_id')
      AND (app_id, query_id, table_id) NOT IN (SELECT app_id, query_id, table_id FROM query_predicates WHERE ends_with(column_id, '.tenant_id'))""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicates = frame(spark, sf_dir, "query_predicates")
    queries = predicates.groupBy("app_id", "query_id").agg(
        F.collect_set("table_id").alias("relations"),
        F.expr("IF(any_value(query_id) = 'q7', 'schema', 'read')").alias("statement_class"),
    )
    return treatment.tenant_enforcement_gaps(
        queries,
        frame(spark, sf_dir, "phys_columns"),
        predicates,
        frame(spark, sf_dir, "app_context"),
    )


_SEQUENCES = """sq AS (SELECT app_id, table_id, concat('0', name) AS pr, name, CASE WHEN shape = 'two' THEN concat(column_id, ',', table_id, '.c1') ELSE column_id END AS sequence FROM phys_indexes
      WHERE method = 'btree' AND predicate IS NULL AND shape <> 'expr' AND direction = 'asc'
    UNION ALL SELECT app_id, table_id, concat('1', name), name, columns FROM phys_constraints WHERE kind IN ('primary_key', 'unique'))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.existing_key_sequences(
        indexes(spark, sf_dir), catalog(spark, sf_dir, "phys")["constraints"]
    )


@query(
    "t05_existing_key_sequences",
    inputs="phys_indexes phys_constraints",
    sql=f"WITH {_SEQUENCES} SELECT app_id, table_id, name, sequence FROM sq",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select(
        "app_id", "table_id", "name", F.array_join("sequence", ",").alias("sequence")
    )


_CANDIDATES = f"""{_SEQUENCES}, g AS (SELECT app_id, query_id, table_id, min(ordinal) AS table_order, list(column_id ORDER BY ordinal, column_id, kind) AS al,
      list(column_id ORDER BY ordinal, column_id, kind) FILTER (WHERE kind = 'equality') AS eq, list(column_id ORDER BY ordinal, column_id, kind) FILTER (WHERE kind <> 'equality') AS rg FROM query_predicates GROUP BY ALL),
    s AS (SELECT app_id, query_id, table_id, table_order, 0 AS so, list_aggregate(list_append(eq, rg[1]), 'string_agg', ',') AS columns FROM g WHERE eq IS NOT NULL AND rg IS NOT NULL
      UNION ALL SELECT app_id, query_id, table_id, table_order, 1, list_aggregate(eq, 'string_agg', ',') FROM g WHERE len(eq) >= 2
      UNION ALL SELECT app_id, query_id, table_id, table_order, 1 + generate_subscripts(al, 1), unnest(al) FROM g),
    d AS (SELECT app_id, query_id, table_id, table_order, columns, min(so) AS so FROM s GROUP BY ALL),
    o AS (SELECT d.*, (SELECT arg_min(name, pr) FROM sq WHERE sq.app_id = d.app_id AND sq.table_id = d.table_id AND (sq.sequence = d.columns OR starts_with(sq.sequence, concat(d.columns, ',')))) AS owner FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY app_id, query_id, owner IS NULL ORDER BY table_order, table_id, so) AS place FROM o)"""
_CAND_INPUTS = "query_predicates phys_indexes phys_constraints"


@query(
    "t04_index_candidates",
    inputs=_CAND_INPUTS,
    sql=f"""WITH {_CANDIDATES} SELECT app_id, query_id, table_id, columns, CASE WHEN owner IS NOT NULL THEN concat('duplicate_of_existing_index:', owner) WHEN place > 5 THEN 'over_candidate_budget' END AS reason FROM p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = candidates.judge_candidates(
        frame(spark, sf_dir, "query_predicates"), sequences(spark, sf_dir), ["app_id", "query_id"]
    )
    return judged.select(
        "app_id", "query_id", "table_id", F.array_join("columns", ",").alias("columns"), "reason"
    )


@query(
    "t06_prefix_duplicates",
    inputs=_CAND_INPUTS,
    sql=f"WITH {_CANDIDATES} SELECT app_id, query_id, table_id, columns, owner FROM p WHERE owner IS NOT NULL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = candidates.candidate_shapes(
        frame(spark, sf_dir, "query_predicates"), ["app_id", "query_id"]
    )
    return (
        candidates.prefix_duplicates(shapes, sequences(spark, sf_dir))
        .where("owner IS NOT NULL")
        .select("app_id", "query_id", "table_id", F.array_join("columns", ",").alias("columns"), "owner")
    )


@query(
    "t07_candidate_ddl",
    inputs=_CAND_INPUTS,
    sql=f"""WITH {_CANDIDATES}, n AS (SELECT app_id, query_id, substr(table_id, 8) AS t, list_transform(string_split(columns, ','), lambda c: split_part(c, '.', 3)) AS l FROM p WHERE owner IS NULL AND place <= 5),
    m AS (SELECT app_id, query_id, t, concat('ix_', t, '_', list_aggregate(l, 'string_agg', '_')) AS name, list_aggregate(l, 'string_agg', ', ') AS cl FROM n)
    SELECT app_id, query_id, name, concat('CREATE INDEX ', name, ' ON "public"."', t, '" (', cl, ')') AS apply_sql, concat('DROP INDEX "public"."', name, '"') AS revert_sql FROM m""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = candidates.index_candidates(
        frame(spark, sf_dir, "query_predicates"), sequences(spark, sf_dir), ["app_id", "query_id"]
    )
    return accepted.select("app_id", "query_id", "name", "apply_sql", "revert_sql")
