"""Context, scenario and decision queries: conversations are interviews, events decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import context
from fleetlens.registry.base import query
from fleetlens.registry.inputs import define, frame

define(
    "context_answers",
    """
SELECT app_id, pos, question, CASE WHEN role = 'system' THEN 'not_asked' WHEN pos % 5 = 4 THEN 'unknown' ELSE 'answered' END AS state,
  CASE question
    WHEN 'core_read_write_mix' THEN concat(n, ':', pos, ', ', CASE WHEN pos % 2 = 0 THEN CAST(n AS STRING) ELSE 'many' END)
    WHEN 'core_tenant_model' THEN CASE n % 3 WHEN 0 THEN 'single_tenant' WHEN 1 THEN 'shared_schema_tenant_id' ELSE 'one of each' END
    WHEN 'core_rpo_rto' THEN CASE WHEN pos % 2 = 0 THEN concat(n, 'm') ELSE concat('5m , ', n, 'm') END
    ELSE text END AS value
FROM (SELECT concat('app-', conv_id) AS app_id, turn AS pos, role, text, length(text) AS n,
  CASE length(text) % 7 WHEN 0 THEN 'core_critical_operations' WHEN 1 THEN 'core_read_write_mix' WHEN 2 THEN 'core_tenant_model'
    WHEN 3 THEN 'core_read_after_write' WHEN 4 THEN 'core_rpo_rto' WHEN 5 THEN 'core_retention' ELSE 'core_table_scale' END AS question
  FROM {conversations}) c
""",
)
define("interview_apps", "SELECT DISTINCT concat('app-', conv_id) AS app_id FROM {conversations}")
_FOLD = "fa AS (SELECT app_id, question, arg_max(state, pos) AS state, arg_max(value, pos) AS value, max(pos) AS pos FROM context_answers GROUP BY ALL)"


@query("x01_fold_answers", inputs="context_answers", sql=f"WITH {_FOLD} SELECT * FROM fa")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.fold_answers(frame(spark, sf_dir, "context_answers"))


def _listed(expression: str) -> str:
    return (
        f"coalesce(array_to_string(list_filter(list_transform(string_split({expression}, ','), "
        "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), '|'), '')"
    )


_DERIVED = f"""g AS (SELECT *, regexp_replace(split_part(value, ',', 1), '^\\s+|\\s+$', '', 'g') AS p1,
      CASE WHEN contains(value, ',') THEN regexp_replace(substr(value, instr(value, ',') + 1), '^\\s+|\\s+$', '', 'g') END AS p2 FROM context_answers WHERE state = 'answered'),
    dc AS (SELECT a.app_id, {_listed("arg_max(value, pos) FILTER (WHERE question = 'core_critical_operations')")} AS critical_operations,
      arg_max(p1, pos) FILTER (WHERE question = 'core_read_write_mix') AS read_write_ratio,
      CAST(arg_max(p2, pos) FILTER (WHERE question = 'core_read_write_mix' AND regexp_full_match(p2, '[0-9]+')) AS BIGINT) AS peak_requests_per_second,
      coalesce(arg_max(value, pos) FILTER (WHERE question = 'core_tenant_model' AND value <> 'one of each'), 'unknown') AS tenant_model,
      {_listed("arg_max(value, pos) FILTER (WHERE question = 'core_read_after_write')")} AS read_after_write_flows,
      arg_max(p1, pos) FILTER (WHERE question = 'core_rpo_rto') AS rpo, arg_max(p2, pos) FILTER (WHERE question = 'core_rpo_rto' AND p2 IS NOT NULL) AS rto,
      {_listed("arg_max(value, pos) FILTER (WHERE question = 'core_retention')")} AS retention_constraints
    FROM (SELECT DISTINCT app_id FROM context_answers) a LEFT JOIN g USING (app_id) GROUP BY 1)"""
_LISTS = ["critical_operations", "read_after_write_flows", "retention_constraints"]


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.array_join(name, "|") for name in _LISTS})


@query("x02_derive_context", inputs="context_answers", sql=f"WITH {_DERIVED} SELECT * FROM dc")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(context.derive_context(frame(spark, sf_dir, "context_answers")))


_QUESTIONS = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(context.CORE_QUESTIONS)) + ") AS q(ord, question)"
_APPLICABLE = f"""ap AS (SELECT app_id, ord, question FROM (SELECT DISTINCT app_id FROM phys_columns) a, {_QUESTIONS}
    WHERE question <> 'core_tenant_model' OR app_id IN (SELECT app_id FROM phys_columns WHERE name = 'tenant_id' AND data_type <> 'bigint'))"""


def _applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = frame(spark, sf_dir, "phys_columns")
    apps = columns.select("app_id").distinct()
    return context.applicable_questions(apps, columns.where("data_type <> 'bigint'"))


@query("x03_applicable_questions", inputs="phys_columns", sql=f"WITH {_APPLICABLE} SELECT * FROM ap")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applicable(spark, sf_dir)


_REMAINING = f"{_APPLICABLE}, rm AS (SELECT * FROM ap WHERE (app_id, question) NOT IN (SELECT app_id, question FROM context_answers))"


@query(
    "x04_remaining_questions",
    inputs="phys_columns context_answers",
    sql=f"WITH {_REMAINING} SELECT * FROM rm",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.remaining_questions(
        _applicable(spark, sf_dir), frame(spark, sf_dir, "context_answers")
    )


@query(
    "x04_next_question",
    inputs="phys_columns context_answers",
    sql=f"WITH {_REMAINING} SELECT app_id, arg_min(question, ord) AS next_question FROM rm GROUP BY 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    remaining = context.remaining_questions(
        _applicable(spark, sf_dir), frame(spark, sf_dir, "context_answers")
    )
    return context.next_question(remaining)


define(
    "table_scales",
    """
SELECT concat('app-', o_custkey) AS app_id, concat('public.orders_', o_orderstatus) AS table_id,
  CASE WHEN max(o_totalprice) > 450000 THEN concat('0', count(*)) ELSE CAST(count(*) AS STRING) END AS current_rows,
  CAST(CAST(round(sum(o_totalprice)) AS BIGINT) AS STRING) AS rows_in_twelve_months
FROM {orders} GROUP BY o_custkey, o_orderstatus
""",
)


@query(
    "x05_table_scale_growth",
    inputs="table_scales",
    sql="""WITH n AS (SELECT app_id, table_id, CASE WHEN starts_with(current_rows, '0') THEN NULL ELSE CAST(current_rows AS DOUBLE) END AS current_rows, CAST(rows_in_twelve_months AS DOUBLE) AS rows_in_twelve_months FROM table_scales)
    SELECT *, round(rows_in_twelve_months / current_rows, 6) AS growth FROM n""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.table_scale_growth(frame(spark, sf_dir, "table_scales")).select(
        "app_id",
        "table_id",
        F.col("current_rows").cast("double").alias("current_rows"),
        F.col("rows_in_twelve_months").cast("double").alias("rows_in_twelve_months"),
        F.round("growth", 6).alias("growth"),
    )


_BLOCKERS = f"""{_FOLD}, rq AS (SELECT * FROM (VALUES ('growth_ready', 0, 'core_table_scale'), ('availability_ready', 0, 'core_rpo_rto'), ('availability_ready', 1, 'core_read_after_write')) AS t(scenario, ord, question)),
    bl AS (SELECT app_id, scenario, ord, question FROM interview_apps, rq WHERE (app_id, question) NOT IN (SELECT app_id, question FROM fa WHERE state = 'answered'))"""


@query(
    "x06_scenario_blockers",
    inputs="context_answers interview_apps",
    sql=f"WITH {_BLOCKERS} SELECT * FROM bl",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.scenario_blockers(
        frame(spark, sf_dir, "interview_apps"), frame(spark, sf_dir, "context_answers")
    )


@query(
    "x07_build_scenarios",
    inputs="context_answers interview_apps cited_findings",
    sql=f"""WITH {_BLOCKERS}, k AS (SELECT * FROM (VALUES ('launch_minimal', 'Launch-minimal'), ('growth_ready', 'Growth-ready'), ('availability_ready', 'Availability-ready')) AS t(scenario, title)),
    n AS (SELECT app_id, count(*) AS c FROM cited_findings GROUP BY 1), b AS (SELECT app_id, scenario, string_agg(question, ',' ORDER BY ord) AS o FROM bl GROUP BY ALL)
    SELECT a.app_id, k.scenario, title, coalesce(c, 0) AS recommendations, coalesce(o, '') AS unresolved_blockers FROM interview_apps a CROSS JOIN k LEFT JOIN n USING (app_id) LEFT JOIN b ON b.app_id = a.app_id AND b.scenario = k.scenario""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = context.build_scenarios(
        frame(spark, sf_dir, "interview_apps"),
        frame(spark, sf_dir, "cited_findings"),
        frame(spark, sf_dir, "context_answers"),
    )
    return built.withColumn("unresolved_blockers", F.array_join("unresolved_blockers", ",")).drop("summary")


@query(
    "x07_scenario_recommendations",
    inputs="cited_findings",
    sql="SELECT app_id, scenario, id AS recommendation FROM cited_findings, (VALUES ('launch_minimal'), ('growth_ready'), ('availability_ready')) AS t(scenario)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.scenario_recommendations(frame(spark, sf_dir, "cited_findings"))


# Two rule runs over the same orders: the later one sees only orders that still stand.
define("run_before", "SELECT app_id, id, priority, change_kind, affected_objects FROM {cited_findings} WHERE measurement IS NULL OR verification_state = 'eligible'")
define("run_after", "SELECT app_id, id, CASE WHEN blocking_question IS NOT NULL THEN 'optional_hardening' ELSE priority END AS priority, change_kind, affected_objects FROM {cited_findings} WHERE priority <> 'optional_hardening' OR measurement IS NULL")


@query(
    "x08_diff_recommendations",
    inputs="run_before run_after",
    sql="""SELECT app_id, kind, id AS recommendation, concat(id, CASE kind WHEN 'added' THEN ' is newly reported.' WHEN 'removed' THEN ' is no longer reported.' ELSE ' is reported differently.' END) AS explanation
    FROM (SELECT app_id, id, CASE WHEN b.priority IS NULL THEN 'added' WHEN a.priority IS NULL THEN 'removed' WHEN a.priority <> b.priority THEN 'changed' END AS kind
      FROM run_before b FULL JOIN run_after a USING (app_id, id)) x WHERE kind IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.diff_recommendations(
        frame(spark, sf_dir, "run_before"), frame(spark, sf_dir, "run_after")
    )


@query(
    "x09_sole_changed_answer",
    inputs="context_answers",
    sql=f"""WITH {_FOLD}, fb AS (SELECT app_id, question, arg_max(state, pos) AS state, arg_max(value, pos) AS value FROM context_answers WHERE pos < 3 GROUP BY ALL),
    ch AS (SELECT app_id, question FROM fa FULL JOIN fb USING (app_id, question) WHERE fa.state IS DISTINCT FROM fb.state OR fa.value IS DISTINCT FROM fb.value)
    SELECT app_id, CASE WHEN count(*) = 1 THEN min(question) END AS caused_by FROM ch GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = frame(spark, sf_dir, "context_answers")
    return context.sole_changed_answer(
        context.fold_answers(answers.where("pos < 3")), context.fold_answers(answers)
    )


define(
    "decisions",
    """
SELECT concat('app-', user_id % 10) AS app_id, concat('IDX-', lpad(CAST(user_id AS STRING), 3, '0')) AS recommendation,
  CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'deferred' WHEN 'error' THEN 'deferred' ELSE 'rejected' END AS kind,
  event_type AS reason, CAST(CAST(ts AS DATE) AS STRING) AS decided_at, concat('sha256:', regexp_extract(props, '[0-9]+', 0)) AS input_manifest_hash, event_id AS pos, value
FROM {events}
""",
)
define(
    "evidence_state",
    "SELECT app_id, max(input_manifest_hash) AS current_hash FROM {decisions} GROUP BY app_id",
)
_LATEST = "ld AS (SELECT app_id, recommendation, arg_max(kind, pos) AS kind, arg_max(input_manifest_hash, pos) AS input_manifest_hash, max(pos) AS pos FROM decisions GROUP BY ALL)"
_DECISION = ["app_id", "recommendation", "kind", "input_manifest_hash", "pos"]


@query("x10_latest_decisions", inputs="decisions", sql=f"WITH {_LATEST} SELECT * FROM ld")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.latest_decisions(frame(spark, sf_dir, "decisions")).select(*_DECISION)


@query(
    "x11_reactivate_decisions",
    inputs="decisions evidence_state",
    sql=f"WITH {_LATEST} SELECT ld.*, current_hash FROM ld JOIN evidence_state USING (app_id) WHERE kind <> 'accepted' AND input_manifest_hash <> current_hash",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.reactivated_decisions(
        frame(spark, sf_dir, "decisions"), frame(spark, sf_dir, "evidence_state")
    ).select(*_DECISION, "current_hash")


@query(
    "x12_changed_decisions",
    inputs="decisions",
    sql="""SELECT app_id, recommendation, kind, input_manifest_hash, pos FROM decisions d
    WHERE NOT EXISTS (SELECT 1 FROM decisions b WHERE b.value <= 60 AND b.app_id = d.app_id AND b.recommendation = d.recommendation AND b.kind = d.kind AND b.decided_at = d.decided_at)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = frame(spark, sf_dir, "decisions")
    return context.changed_decisions(head.where("value <= 60"), head).select(*_DECISION)


def _json(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN 'null' ELSE CAST(to_json({name}) AS VARCHAR) END"


def _json_list(name: str) -> str:
    return f"CASE WHEN {name} = '' THEN '[]' ELSE CAST(to_json(string_split({name}, '|')) AS VARCHAR) END"


@query(
    "x13_context_hash",
    inputs="context_answers",
    sql=f"""WITH {_DERIVED} SELECT app_id, concat('sha256:', sha256(concat('{{"critical_operations":', {_json_list("critical_operations")}, ',"peak_requests_per_second":', coalesce(CAST(peak_requests_per_second AS VARCHAR), 'null'),
      ',"read_after_write_flows":', {_json_list("read_after_write_flows")}, ',"read_write_ratio":', {_json("read_write_ratio")}, ',"retention_constraints":', {_json_list("retention_constraints")},
      ',"rpo":', {_json("rpo")}, ',"rto":', {_json("rto")}, ',"tenant_model":', {_json("tenant_model")}, '}}'))) AS context_hash FROM dc""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.context_hash(context.derive_context(frame(spark, sf_dir, "context_answers")))


define(
    "known_recommendations",
    "SELECT DISTINCT app_id, recommendation AS id FROM {decisions} WHERE kind = 'accepted' AND value > 90",
)


@query(
    "x14_decision_validity",
    inputs="decisions evidence_state known_recommendations",
    sql="""SELECT d.app_id, recommendation, pos, CASE WHEN k.id IS NOT NULL THEN current_hash END AS input_manifest_hash, k.id IS NOT NULL AS accepted
    FROM decisions d JOIN evidence_state USING (app_id) LEFT JOIN known_recommendations k ON k.app_id = d.app_id AND k.id = d.recommendation""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, unknown = context.decision_validity(
        frame(spark, sf_dir, "decisions"),
        frame(spark, sf_dir, "known_recommendations"),
        frame(spark, sf_dir, "evidence_state"),
    )
    fields = ["app_id", "recommendation", "pos"]
    none = F.lit(None).cast("string").alias("input_manifest_hash")
    return accepted.select(*fields, "input_manifest_hash", F.lit(True).alias("accepted")).unionByName(
        unknown.select(*fields, none, F.lit(False).alias("accepted"))
    )
