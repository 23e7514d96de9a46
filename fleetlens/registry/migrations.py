"""Migration queries: eight orders in a row are the revisions of one application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import migrations, replay
from fleetlens.registry.base import query
from fleetlens.registry.inputs import define, frame
from fleetlens.sources.scratch import materialize

_REV = "concat('r', lpad(CAST({0} AS STRING), 9, '0'))"
define(
    "revisions",
    f"""
SELECT concat('app-', CAST(floor(k / 8) AS BIGINT)) AS app_id, {_REV.format("k")} AS revision, prio, status, price,
  CASE k % 8
    WHEN 0 THEN CASE WHEN status = 'F' AND prio = '1-URGENT' THEN {_REV.format("k + 7")} WHEN status = 'P' AND prio = '5-LOW' THEN 'gone' ELSE '' END
    WHEN 1 THEN {_REV.format("k - 1")}
    WHEN 2 THEN {_REV.format("k - 2")}
    WHEN 3 THEN concat({_REV.format("k - 2")}, ',', {_REV.format("k - 1")})
    WHEN 7 THEN CASE WHEN prio = '2-HIGH' THEN {_REV.format("k - 2")} ELSE {_REV.format("k - 1")} END
    ELSE {_REV.format("k - 1")} END AS parents
FROM (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS prio, o_totalprice AS price FROM {{orders}}) o
""",
)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.when(F.col("parents") == "", F.array().cast("array<string>")).otherwise(
        F.split("parents", ",")
    )
    return frame(spark, sf_dir, "revisions").withColumn("parents", parents)


_EDGES = "pe AS (SELECT app_id, revision, unnest(string_split(parents, ',')) AS parent FROM revisions WHERE parents <> '')"
_ROLES = f"""{_EDGES}, roles AS (SELECT app_id, 'root' AS role, revision FROM revisions WHERE parents = ''
    UNION ALL SELECT app_id, 'head', revision FROM revisions WHERE (app_id, revision) NOT IN (SELECT app_id, parent FROM pe)
    UNION ALL SELECT app_id, 'merge', revision FROM revisions WHERE contains(parents, ',')
    UNION ALL SELECT DISTINCT app_id, 'missing', parent FROM pe WHERE (app_id, parent) NOT IN (SELECT app_id, revision FROM revisions))"""
_REACH = f"""{_EDGES}, ke AS (SELECT * FROM pe WHERE (app_id, parent) IN (SELECT app_id, revision FROM revisions)),
    reach(app_id, revision, parent) AS (SELECT app_id, revision, parent FROM ke UNION SELECT r.app_id, r.revision, k.parent FROM reach r JOIN ke k ON k.app_id = r.app_id AND k.revision = r.parent)"""
_OBSTACLES = """cyc AS (SELECT DISTINCT app_id FROM reach WHERE revision = parent),
    fct AS (SELECT app_id, count(*) FILTER (WHERE role = 'head') AS heads, count(*) FILTER (WHERE role = 'missing') AS missing FROM roles GROUP BY 1),
    obst AS (SELECT app_id, concat('schema not replayed: the revision graph has ', CASE WHEN app_id IN (SELECT app_id FROM cyc) THEN 'a revision cycle' WHEN missing > 0 THEN 'a missing predecessor' ELSE concat(heads, ' heads') END) AS reason
      FROM fct WHERE app_id IN (SELECT app_id FROM cyc) OR missing > 0 OR heads <> 1)"""
_ALL = f"{_REACH}, {_ROLES.split(', roles AS ')[1].join(['roles AS ', ''])}, {_OBSTACLES}"


@query("m01_revision_graph", inputs="revisions", sql=f"WITH {_ROLES} SELECT * FROM roles")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.revision_graph(revisions(spark, sf_dir))


@query(
    "m02_revision_cycles",
    inputs="revisions",
    sql=f"WITH RECURSIVE {_REACH} SELECT app_id, revision AS node, greatest(max(parent), revision) AS component FROM (SELECT r.* FROM reach r WHERE (r.app_id, r.parent, r.revision) IN (SELECT app_id, revision, parent FROM reach)) x GROUP BY app_id, revision",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.revision_cycles(revisions(spark, sf_dir))


@query(
    "m03_revision_order",
    inputs="revisions",
    sql=f"""WITH RECURSIVE {_ALL}, lv(app_id, revision, level) AS (SELECT app_id, revision, 0 FROM revisions WHERE parents = '' AND app_id NOT IN (SELECT app_id FROM obst)
      UNION SELECT l.app_id, k.revision, l.level + 1 FROM lv l JOIN ke k ON k.app_id = l.app_id AND k.parent = l.revision),
    mx AS (SELECT app_id, revision, max(level) AS level FROM lv GROUP BY ALL)
    SELECT app_id, revision, level, row_number() OVER (PARTITION BY app_id ORDER BY level, revision) AS position FROM mx""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.revision_order(revisions(spark, sf_dir))


@query(
    "m03_replay_obstacles", inputs="revisions", sql=f"WITH RECURSIVE {_ALL} SELECT * FROM obst"
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.replay_obstacles(revisions(spark, sf_dir))


# The operation log: every supplier is one application, every line one operation.
define(
    "migration_ops",
    """
SELECT concat('app-', l_suppkey) AS app_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS pos, concat('r', l_orderkey % 40) AS revision,
  CASE WHEN m < 18 THEN 'create_table' WHEN m < 25 THEN 'drop_table' WHEN m < 33 THEN 'rename_table' WHEN m < 52 THEN 'add_column' WHEN m < 60 THEN 'drop_column'
    WHEN m < 76 THEN 'alter_column' WHEN m < 80 THEN 'create_primary_key' WHEN m < 85 THEN 'create_foreign_key' WHEN m < 88 THEN 'create_unique_constraint'
    WHEN m < 91 THEN 'create_check_constraint' WHEN m < 94 THEN 'drop_constraint' WHEN m < 98 THEN 'create_index' ELSE 'drop_index' END AS kind,
  concat('t', l_orderkey % 5) AS table_name, concat('c', l_partkey % 4) AS object_no,
  CASE WHEN m >= 25 AND m < 33 THEN concat('t', l_partkey % 7) WHEN m >= 52 AND m < 76 AND l_returnflag = 'R' THEN concat('c', l_linenumber % 5) END AS new_name,
  concat('t', l_partkey % 5) AS ref_table, CASE WHEN l_returnflag <> 'A' THEN l_discount > 0.05 END AS nullable, l_returnflag <> 'A' AS has_nullable,
  CASE WHEN l_linestatus = 'O' THEN concat('type', l_linenumber) END AS new_type, l_tax > 0.05 AS has_default,
  CASE WHEN l_tax > 0.05 THEN concat('d', l_linenumber) END AS server_default, l_quantity > 30 AS online_build, l_quantity < 20 AS primary_key
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS m FROM {lineitem}) l
""",
)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "migration_ops").withColumnRenamed("online_build", "concurrently")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with object names by kind, and the columns of each create as own rows."""
    log = _log(spark, sf_dir)
    constraint = F.col("kind").rlike("constraint|_key")
    log = log.withColumn(
        "object_name",
        F.when(constraint, F.concat("table_name", F.lit("_k"), "object_no"))
        .when(F.col("kind").contains("index"), F.concat("table_name", F.lit("_i"), "object_no"))
        .otherwise(F.col("object_no")),
    ).withColumn("columns", F.array("object_no"))
    # One pass over the log: a create is followed by the rows of its two columns.
    rows = F.when(F.col("kind") == "create_table", F.array(F.lit(0), F.lit(1), F.lit(2)))
    log = log.withColumn("made", F.explode(F.coalesce(rows, F.array(F.lit(0)))))
    made, second = F.col("made") > 0, F.col("made") == 2
    log = log.withColumn("kind", F.when(made, F.lit("create_column")).otherwise(F.col("kind")))
    defines = F.col("kind").isin("create_column", "add_column")
    return log.select(
        *[
            {
                "object_name": F.when(second, F.lit("c9")).otherwise(F.col("object_name")),
                "new_name": F.when(~made, F.col("new_name")),
                "nullable": F.when(defines, F.coalesce("nullable", F.lit(True))).otherwise(F.col("nullable")),
                "new_type": F.when(defines, F.coalesce("new_type", F.lit("unknown"))).otherwise(F.col("new_type")),
                "primary_key": F.when(second, F.lit(False)).otherwise(F.col("primary_key")),
            }.get(c, F.col(c)).alias(c)
            for c in log.columns
            if c != "made"
        ]
    )


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, replay.Lifetimes]:
    log = materialize(operations(spark, sf_dir), "operations")
    return log, replay.table_lifetimes(log)


# The checking SQL walks each application's log with one text as state: <table=create position>,
# [table#column|id table|type|nullable|default] and !position! for columns of unknown tables.
def _f(n: int) -> str:
    return f"split_part(e, ',', {n})"


_TABLE, _COLUMN, _NEW, _POS = _f(2), _f(4), _f(5), _f(3)


def _without(state: str, table: str) -> str:
    return f"regexp_replace({state}, concat('<', {table}, '=[0-9]+>|\\[', {table}, '#[^\\]]*\\]'), '', 'g')"


def _without_column(state: str, column: str) -> str:
    return f"regexp_replace({state}, concat('\\[', {_TABLE}, '#', {column}, '[|][^\\]]*\\]'), '', 'g')"


def _held(n: int) -> str:
    return f"split_part(regexp_extract(a, concat('\\[', {_TABLE}, '#', {_COLUMN}, '[|]([^\\]]*)\\]'), 1), '|', {n})"


def _kept(n: int, part: int) -> str:
    return f"CASE WHEN {_f(n)} = '-' THEN {_held(part)} ELSE {_f(n)} END"


_TARGET = f"CASE WHEN {_NEW} = '-' THEN {_COLUMN} ELSE {_NEW} END"
_WALK = f"""lg AS (SELECT app_id, pos, 2 AS o, concat_ws(',', kind, table_name, pos, object_no, coalesce(new_name, '-'),
      coalesce(new_type, CASE WHEN kind = 'add_column' THEN 'unknown' ELSE '-' END), coalesce(CAST(nullable AS VARCHAR), CASE WHEN kind = 'add_column' THEN 'true' ELSE '-' END), coalesce(server_default, '-')) AS e
      FROM migration_ops WHERE kind IN ('create_table', 'drop_table', 'rename_table', 'add_column', 'drop_column', 'alter_column')
    UNION ALL SELECT app_id, pos, 3, concat_ws(',', 'add_column', table_name, pos, c, '-', coalesce(new_type, 'unknown'), coalesce(CAST(nullable AS VARCHAR), 'true'), coalesce(server_default, '-'))
      FROM (SELECT *, unnest([object_no, 'c9']) AS c FROM migration_ops WHERE kind = 'create_table') m),
    wk AS (SELECT app_id, list_reduce(list_prepend('', list(e ORDER BY pos, o)), lambda a, e: CASE {_f(1)}
      WHEN 'create_table' THEN concat({_without("a", _TABLE)}, '<', {_TABLE}, '=', {_POS}, '>')
      WHEN 'drop_table' THEN {_without("a", _TABLE)}
      WHEN 'rename_table' THEN CASE WHEN {_TABLE} = {_NEW} OR NOT contains(a, concat('<', {_TABLE}, '=')) THEN a
        ELSE replace(replace({_without("a", _NEW)}, concat('<', {_TABLE}, '='), concat('<', {_NEW}, '=')), concat('[', {_TABLE}, '#'), concat('[', {_NEW}, '#')) END
      WHEN 'add_column' THEN CASE WHEN NOT contains(a, concat('<', {_TABLE}, '=')) THEN concat(a, '!', {_POS}, '!')
        ELSE concat({_without_column("a", _COLUMN)}, '[', {_TABLE}, '#', {_COLUMN}, '|', {_TABLE}, '|', {_f(6)}, '|', {_f(7)}, '|', {_f(8)}, ']') END
      WHEN 'drop_column' THEN {_without_column("a", _COLUMN)}
      ELSE CASE WHEN {_held(1)} = '' THEN a ELSE concat({_without_column(_without_column("a", _COLUMN), _TARGET)}, '[', {_TABLE}, '#', {_TARGET}, '|', {_TABLE}, '|', {_kept(6, 2)}, '|', {_kept(7, 3)}, '|', {_kept(8, 4)}, ']') END
      END) AS state FROM lg GROUP BY app_id)"""


@query(
    "m04_replay_tables",
    inputs="migration_ops",
    sql=f"""WITH {_WALK}, t AS (SELECT app_id, unnest(regexp_extract_all(state, '<([^>]*)>', 1)) AS x FROM wk)
    SELECT app_id, split_part(x, '=', 1) AS table_name, CAST(split_part(x, '=', 2) AS BIGINT) AS first_pos FROM t""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_tables(_history(spark, sf_dir)[1]).drop("first_name")


@query(
    "m04_replay_columns",
    inputs="migration_ops",
    sql=f"""WITH {_WALK}, t AS (SELECT app_id, unnest(regexp_extract_all(state, '\\[([^\\]]*)\\]', 1)) AS x FROM wk),
    p AS (SELECT app_id, split_part(x, '#', 1) AS table_name, split_part(split_part(x, '#', 2), '|', 1) AS column_name, split_part(x, '|', 2) AS id_table, split_part(x, '|', 3) AS ty, split_part(x, '|', 4) AS nu, split_part(x, '|', 5) AS de FROM t)
    SELECT app_id, table_name, column_name, concat('public.', id_table, '.', column_name) AS column_id, ty AS data_type, CAST(nu AS BOOLEAN) AS nullable, nullif(de, '-') AS default_expression FROM p""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, tables = _history(spark, sf_dir)
    return replay.replay_columns(log, tables)


@query(
    "m04_unknown_tables",
    inputs="migration_ops",
    sql=f"""WITH {_WALK}, u AS (SELECT app_id, CAST(unnest(regexp_extract_all(state, '!([0-9]+)!', 1)) AS BIGINT) AS pos FROM wk)
    SELECT u.app_id, u.pos, concat('add_column on unknown table ''', table_name, '''') AS reason FROM u JOIN migration_ops m ON m.app_id = u.app_id AND m.pos = u.pos""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, tables = _history(spark, sf_dir)
    return replay.unknown_table_operations(log, tables)


_GONE = """tdrop AS (SELECT app_id, table_name, max(pos) AS p FROM migration_ops WHERE kind = 'drop_table' GROUP BY ALL)"""


@query(
    "m04_replay_constraints",
    inputs="migration_ops",
    sql=f"""WITH {_GONE}, mk AS (SELECT app_id, concat(table_name, '_k', object_no) AS name, pos, revision, table_name,
        CASE kind WHEN 'create_primary_key' THEN 'primary_key' WHEN 'create_foreign_key' THEN 'foreign_key' WHEN 'create_unique_constraint' THEN 'unique' ELSE 'check' END AS kind, object_no AS col
      FROM migration_ops WHERE kind IN ('create_primary_key', 'create_foreign_key', 'create_unique_constraint', 'create_check_constraint')
      UNION ALL SELECT app_id, concat('pk_', table_name), pos, revision, table_name, 'primary_key', object_no FROM migration_ops WHERE kind = 'create_table' AND primary_key),
    lt AS (SELECT app_id, name, max(pos) AS pos, arg_max(revision, pos) AS revision, arg_max(table_name, pos) AS table_name, arg_max(kind, pos) AS kind, arg_max(col, pos) AS col FROM mk GROUP BY ALL),
    dr AS (SELECT app_id, concat(table_name, '_k', object_no) AS name, max(pos) AS p FROM migration_ops WHERE kind = 'drop_constraint' GROUP BY ALL)
    SELECT lt.app_id, lt.name, kind, concat('public.', lt.table_name) AS table_id, concat('public.', lt.table_name, '.', col) AS columns, revision FROM lt LEFT JOIN dr USING (app_id, name) LEFT JOIN tdrop t ON t.app_id = lt.app_id AND t.table_name = lt.table_name
    WHERE lt.pos > coalesce(dr.p, -1) AND lt.pos > coalesce(t.p, -1)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        replay.replay_constraints(operations(spark, sf_dir))
        .withColumn("columns", F.array_join("columns", ","))
        .drop("referenced_table")
    )


@query(
    "m04_replay_indexes",
    inputs="migration_ops",
    sql=f"""WITH {_GONE}, lt AS (SELECT app_id, concat(table_name, '_i', object_no) AS name, max(pos) AS pos, arg_max(revision, pos) AS revision, max(table_name) AS table_name, max(object_no) AS col
      FROM migration_ops WHERE kind = 'create_index' GROUP BY app_id, concat(table_name, '_i', object_no)),
    dr AS (SELECT app_id, concat(table_name, '_i', object_no) AS name, max(pos) AS p FROM migration_ops WHERE kind = 'drop_index' GROUP BY ALL)
    SELECT lt.app_id, lt.name, concat('public.', lt.table_name) AS table_id, concat('public.', lt.table_name, '.', col) AS columns, revision FROM lt LEFT JOIN dr USING (app_id, name) LEFT JOIN tdrop t ON t.app_id = lt.app_id AND t.table_name = lt.table_name
    WHERE lt.pos > coalesce(dr.p, -1) AND lt.pos > coalesce(t.p, -1)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_indexes(operations(spark, sf_dir)).withColumn(
        "columns", F.array_join("columns", ",")
    )


@query(
    "m05_migration_risks",
    inputs="migration_ops",
    sql="""WITH cr AS (SELECT DISTINCT app_id, revision, table_name FROM migration_ops WHERE kind = 'create_table'),
    x AS (SELECT o.*, (app_id, revision, table_name) IN (SELECT app_id, revision, table_name FROM cr) AS fresh FROM migration_ops o),
    y AS (SELECT app_id, revision, pos, kind AS operation, CASE WHEN kind = 'drop_table' THEN 'destructive' WHEN fresh THEN NULL WHEN kind = 'drop_column' THEN 'destructive' WHEN kind = 'drop_constraint' THEN 'constraint'
      WHEN kind IN ('create_unique_constraint', 'create_foreign_key', 'create_check_constraint') THEN 'constraint' WHEN kind = 'add_column' AND has_nullable AND NOT nullable AND NOT has_default THEN 'constraint'
      WHEN kind = 'alter_column' AND new_type IS NOT NULL THEN 'type_change' WHEN kind = 'create_index' AND NOT online_build THEN 'index' END AS category FROM x)
    SELECT *, NOT (category = 'destructive' OR category = 'type_change') AS reversible, CASE WHEN operation = 'add_column' THEN 'assumes PostgreSQL 11+' WHEN category = 'type_change' THEN 'ALTER COLUMN TYPE rewri' END AS assumption,
      CASE WHEN operation IN ('create_unique_constraint', 'create_foreign_key', 'create_check_constraint') THEN 'add_constraint' WHEN category = 'type_change' THEN 'alter_column' WHEN category = 'index' THEN 'add_index' END AS change_kind
    FROM y WHERE category IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    risks = migrations.migration_risks(log).drop("reason")
    return risks.withColumn(
        "assumption",
        F.when(F.col("assumption").startswith("assumes"), F.split_part("assumption", F.lit(":"), F.lit(1))).otherwise(
            F.substring("assumption", 1, 23)
        ),
    )


@query(
    "m06_added_revisions",
    inputs="revisions",
    sql="SELECT app_id, revision FROM revisions WHERE NOT (status = 'F' AND price > 100000)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = frame(spark, sf_dir, "revisions").select("app_id", "revision", "status", "price")
    base = current.where("status = 'F' AND price > 100000")
    return migrations.added_revisions(base, current).select("app_id", "revision")


define(
    "proposed_changes",
    """
SELECT concat('app-', o_custkey) AS app_id, concat('IDX-', lpad(CAST(o_orderkey AS STRING), 6, '0')) AS id,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'add_constraint' WHEN '2' THEN 'add_index' WHEN '3' THEN 'alter_column' WHEN '4' THEN 'drop_index' END AS change_kind,
  concat('Change ', o_orderstatus, '.') AS change_summary, CASE WHEN o_totalprice > 100000 THEN 'Put it back.' END AS rollback_note
FROM {orders}
""",
)
_STEPS = """st AS (SELECT app_id, id AS recommendation, concat('["', id, '",0]') AS step_id, '' AS dependencies,
      CASE change_kind WHEN 'add_constraint' THEN concat(change_summary, ' Add it NOT VALID so existing rows are not checked immediately.') WHEN 'add_index' THEN concat(change_summary, ' Create it CONCURRENTLY to avoid locking writes.') ELSE change_summary END AS schema_action,
      CASE change_kind WHEN 'add_constraint' THEN 'Drop the NOT VALID constraint; no data was altered.' WHEN 'add_index' THEN 'Drop the index; no data was altered.' ELSE coalesce(rollback_note, 'No rollback sketch is available for this change.') END AS rollback_note
      FROM proposed_changes WHERE change_kind IS NOT NULL
    UNION ALL SELECT app_id, id, concat('["', id, '",1]'), concat('["', id, '",0]'), 'Run VALIDATE CONSTRAINT to check existing rows without blocking concurrent writes.', 'A failed validation leaves the constraint NOT VALID; nothing to undo.'
      FROM proposed_changes WHERE change_kind = 'add_constraint')"""


@query("m07_expand_plan_steps", inputs="proposed_changes", sql=f"WITH {_STEPS} SELECT * FROM st")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = migrations.expand_plan_steps(frame(spark, sf_dir, "proposed_changes"), "launch_minimal")
    return steps.select(
        "app_id",
        "recommendation",
        "step_id",
        F.array_join("dependency_ids", ",").alias("dependencies"),
        "schema_action",
        "rollback_note",
    )


# Ten parts in a row are the steps of one plan; some plans hold a cycle.
define(
    "plan_steps",
    """
SELECT concat('app-', CAST(floor(p_partkey / 10) AS BIGINT)) AS app_id, concat('s', p_partkey % 10) AS step_id,
  CASE WHEN p_partkey % 10 = 2 AND p_size < 5 THEN 's1,s8' WHEN p_partkey % 10 < 2 THEN '' WHEN p_size % 3 = 0 THEN concat('s', p_partkey % 10 - 1, ',s', p_partkey % 10 - 2)
    ELSE concat('s', p_partkey % 10 - 2) END AS dependencies, p_size
FROM {part}
""",
)


def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("dependencies") == "", F.array().cast("array<string>")).otherwise(
        F.split("dependencies", ",")
    )
    return frame(spark, sf_dir, "plan_steps").withColumn("dependency_ids", listed)


_PLAN = """de AS (SELECT app_id, step_id, unnest(string_split(dependencies, ',')) AS dep FROM plan_steps WHERE dependencies <> ''),
    rc(app_id, step_id, dep) AS (SELECT * FROM de UNION SELECT r.app_id, r.step_id, d.dep FROM rc r JOIN de d ON d.app_id = r.app_id AND d.step_id = r.dep),
    onc AS (SELECT DISTINCT app_id, step_id FROM rc WHERE step_id = dep),
    bad AS (SELECT DISTINCT app_id, step_id FROM rc WHERE (app_id, dep) IN (SELECT app_id, step_id FROM onc))"""


@query(
    "m08_plan_order",
    inputs="plan_steps",
    sql=f"""WITH RECURSIVE {_PLAN}, lv(app_id, step_id, level) AS (SELECT app_id, step_id, 0 FROM plan_steps WHERE dependencies = '' AND app_id NOT IN (SELECT app_id FROM bad)
      UNION SELECT l.app_id, d.step_id, l.level + 1 FROM lv l JOIN de d ON d.app_id = l.app_id AND d.dep = l.step_id),
    mx AS (SELECT app_id, step_id, max(level) AS level FROM lv GROUP BY ALL)
    SELECT app_id, step_id, level, row_number() OVER (PARTITION BY app_id ORDER BY level, step_id) AS position FROM mx""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.plan_order(plan_steps(spark, sf_dir))[0]


@query(
    "m08_plan_cycles", inputs="plan_steps", sql=f"WITH RECURSIVE {_PLAN} SELECT * FROM bad"
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migrations.plan_order(plan_steps(spark, sf_dir))[1]


@query(
    "m09_plan_integrity",
    inputs="plan_steps",
    sql="""WITH s AS (SELECT app_id, step_id, dependencies FROM plan_steps WHERE p_size <> 7 UNION ALL SELECT app_id, step_id, '' FROM plan_steps WHERE p_size = 9),
    d AS (SELECT DISTINCT app_id, unnest(string_split(dependencies, ',')) AS step_id FROM s WHERE dependencies <> '')
    SELECT app_id, 'plan step ids must be unique' AS problem, step_id FROM s GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT app_id, 'plan steps depend on unknown step ids', step_id FROM d WHERE (app_id, step_id) NOT IN (SELECT app_id, step_id FROM s)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = plan_steps(spark, sf_dir).select("app_id", "step_id", "dependency_ids", "p_size")
    empty = F.array().cast("array<string>")
    again = steps.where("p_size = 9").withColumn("dependency_ids", empty)
    return migrations.plan_integrity(steps.where("p_size <> 7").unionByName(again))


@query(
    "m10_select_physical_schema",
    sql="""WITH e AS (SELECT o_custkey AS app_id, o_orderkey AS ord, concat('env-', o_orderkey % 3) AS environment, CASE WHEN o_orderstatus = 'F' THEN concat('h', o_orderkey) END AS head FROM orders)
    SELECT app_id, arg_min(environment, ord) FILTER (WHERE head IS NOT NULL) AS environment, arg_min(head, ord) FILTER (WHERE head IS NOT NULL) AS head FROM e GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    environments = frame(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS app_id",
        "o_orderkey AS ord",
        "concat('env-', o_orderkey % 3) AS environment",
        "IF(o_orderstatus = 'F', concat('h', o_orderkey), NULL) AS head",
    )
    return migrations.select_physical_schema(environments)
