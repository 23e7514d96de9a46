"""Quality, lineage, leak, file and catalog-source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.identity import SHA256_PATTERN, SNAKE_CASE_PATTERN, rfc3339
from fleetlens.operators import quality
from fleetlens.operators.quality import FieldRule
from fleetlens.registry.base import query
from fleetlens.registry.catalog import findings
from fleetlens.registry.inputs import define, frame, table, trie_sql
from fleetlens.sources import artifacts as artifact_source
from fleetlens.sources import catalog as catalog_source
from fleetlens.sources import files as file_source
from fleetlens.sources.scratch import new_path

define(
    "doc_artifacts",
    """
SELECT concat(lang, '/', source) AS run_id, lang AS artifact_type, concat('doc_', doc_id - CASE WHEN n_chars % 7 = 0 THEN 40 ELSE 0 END, '.json') AS path, text AS content,
  CASE n_chars % 11 WHEN 0 THEN '2.0' WHEN 1 THEN '1.9' WHEN 2 THEN '01.3' ELSE '1.3' END AS schema_version, n_chars, doc_id
FROM {documents}
""",
)


@query(
    "q01_write_artifacts",
    sql="""SELECT lang AS app_id, 'document' AS artifact_type, concat('sha256:', sha256(concat('{"doc_id":', doc_id, ',"source":', to_json(source), ',"text":', to_json(text), '}'))) AS content_hash FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("app_id"), F.lit("document").alias("artifact_type"), "doc_id", "source", "text"
    )
    path = new_path(spark, "artifacts")
    artifact_source.write_artifacts(documents, path)
    return artifact_source.read_artifacts(spark, path).drop("document")


@query(
    "q02_build_manifest",
    inputs="doc_artifacts",
    sql="SELECT run_id, artifact_type, path, concat('sha256:', sha256(content)) AS content_hash, schema_version FROM doc_artifacts",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.build_manifest(frame(spark, sf_dir, "doc_artifacts"))[0]


@query(
    "q02_repeated_paths",
    inputs="doc_artifacts",
    sql="SELECT artifact_type AS run_id, path, count(*) AS n FROM doc_artifacts GROUP BY ALL HAVING count(*) > 1",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = frame(spark, sf_dir, "doc_artifacts").withColumn("run_id", F.col("artifact_type"))
    return quality.build_manifest(documents)[1]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk now: some files are gone, some were edited."""
    present = frame(spark, sf_dir, "doc_artifacts").where("n_chars % 17 <> 0")
    text = F.when(F.col("n_chars") % 13 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content"))
    return present.select(
        "run_id", "path", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("actual_hash")
    )


@query(
    "q03_verify_manifest",
    inputs="doc_artifacts",
    sql="""WITH d AS (SELECT run_id, path, n_chars, schema_version, concat('sha256:', sha256(content)) AS h, concat('sha256:', sha256(concat(content, CASE WHEN n_chars % 13 = 0 THEN ' ' ELSE '' END))) AS a FROM doc_artifacts)
    SELECT e.run_id, e.path, CASE WHEN e.schema_version IN ('2.0', '01.3') THEN 'artifact schema version is not supported' WHEN f.a IS NULL THEN 'recorded in manifest but missing on disk' WHEN f.a <> e.h THEN 'content hash mismatch' END AS problem
    FROM d e LEFT JOIN (SELECT * FROM d WHERE n_chars % 17 <> 0) f ON e.run_id = f.run_id AND e.path = f.path WHERE problem IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _repeated = quality.build_manifest(frame(spark, sf_dir, "doc_artifacts"))
    return quality.verify_manifest(entries, _files(spark, sf_dir))


define(
    "bundles",
    "SELECT run_id AS bundle_id, CASE WHEN min(n_chars) > 60 THEN 'p' END AS proof_id, 't' AS tool_version, CASE WHEN count(*) % 7 <> 0 THEN '1.3' END AS schema_version, 'g' AS generator_version FROM {doc_artifacts} GROUP BY run_id",
)
_BUNDLE = """br AS (SELECT bundle_id, unnest([CASE WHEN proof_id IS NULL THEN 'manifest is missing field ''proof_id''' END, CASE WHEN schema_version IS NULL THEN 'manifest is missing field ''schema_version''' END]) AS problem FROM bundles),
    d AS (SELECT run_id, path, n_chars, concat('sha256:', sha256(content)) AS h, concat('sha256:', sha256(concat(content, CASE WHEN n_chars % 13 = 0 THEN ' ' ELSE '' END))) AS a FROM doc_artifacts),
    pr AS (SELECT bundle_id, problem FROM br WHERE problem IS NOT NULL UNION ALL SELECT e.run_id, CASE WHEN f.a IS NULL THEN concat(e.path, ' is missing') WHEN f.a <> e.h THEN concat(e.path, ' does not match its declared hash (tampered)') END AS problem
      FROM d e LEFT JOIN (SELECT * FROM d WHERE n_chars % 17 <> 0) f ON e.run_id = f.run_id AND e.path = f.path WHERE e.run_id NOT IN (SELECT bundle_id FROM br WHERE problem IS NOT NULL) AND (f.a IS NULL OR f.a <> e.h))"""


def _bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    declared = quality.build_manifest(frame(spark, sf_dir, "doc_artifacts"))[0]
    return quality.verify_bundles(
        frame(spark, sf_dir, "bundles"),
        declared.select(F.col("run_id").alias("bundle_id"), "path", "content_hash"),
        _files(spark, sf_dir).withColumnRenamed("run_id", "bundle_id"),
    )


@query("q04_verify_bundle", inputs="doc_artifacts bundles", sql=f"WITH {_BUNDLE} SELECT * FROM pr")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundles(spark, sf_dir)[0]


@query(
    "q04_bundle_trust",
    inputs="doc_artifacts bundles",
    sql=f"WITH {_BUNDLE} SELECT bundle_id, bundle_id NOT IN (SELECT bundle_id FROM pr) AS trusted FROM bundles",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundles(spark, sf_dir)[1]


_CITED = "ci AS (SELECT app_id, id, unnest(string_split(evidence_refs, ',')) AS evidence_id FROM cited_findings), ev AS (SELECT * FROM cited_evidence WHERE path IS NOT NULL)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "cited_evidence").where("path IS NOT NULL")


@query(
    "q05_dangling_evidence",
    inputs="cited_findings cited_evidence",
    sql=f"WITH {_CITED} SELECT DISTINCT app_id, evidence_id FROM ci WHERE (app_id, evidence_id) NOT IN (SELECT app_id, evidence_id FROM ev)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dangling_evidence(findings(spark, sf_dir), _evidence(spark, sf_dir))


@query(
    "q06_untraceable_findings",
    inputs="cited_findings cited_evidence",
    sql=f"WITH {_CITED} SELECT app_id, id FROM cited_findings WHERE (app_id, id) NOT IN (SELECT app_id, id FROM ci WHERE (app_id, evidence_id) IN (SELECT app_id, evidence_id FROM ev))",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.untraceable_findings(findings(spark, sf_dir), _evidence(spark, sf_dir))


define(
    "asked_questions",
    "SELECT app_id, 'core_retention' AS question, concat(id, ',', replace(id, 'IDX', 'OLD')) AS affected FROM {cited_findings} WHERE blocking_question IS NOT NULL AND measurement IS NULL AND priority <> 'worth_evaluating'",
)
define(
    "scenario_refs",
    "SELECT app_id, CASE WHEN priority = 'optional_hardening' THEN replace(id, 'IDX', 'GONE') ELSE id END AS recommendation FROM {cited_findings}",
)


@query(
    "q07_dangling_links",
    inputs="cited_findings asked_questions scenario_refs",
    sql="""SELECT DISTINCT app_id, 'blocking_question' AS link, blocking_question AS target FROM cited_findings WHERE blocking_question IS NOT NULL AND (app_id, blocking_question) NOT IN (SELECT app_id, question FROM asked_questions)
    UNION ALL SELECT DISTINCT app_id, 'affected_recommendation', t FROM (SELECT app_id, unnest(string_split(affected, ',')) AS t FROM asked_questions) a WHERE (app_id, t) NOT IN (SELECT app_id, id FROM cited_findings)
    UNION ALL SELECT DISTINCT app_id, 'scenario_recommendation', recommendation FROM scenario_refs WHERE (app_id, recommendation) NOT IN (SELECT app_id, id FROM cited_findings)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = frame(spark, sf_dir, "asked_questions").withColumn("affected", F.split("affected", ","))
    return quality.dangling_links(findings(spark, sf_dir), asked, frame(spark, sf_dir, "scenario_refs"))


RECORD_RULES = [
    FieldRule("event", "sequence", "required"),
    FieldRule("event", "duration_us", "at_least", 500),
    FieldRule("event", "phase", "one_of", ("setup", "call", "teardown")),
    FieldRule("event", "statement", "non_empty"),
    FieldRule("event", "value_hash", "pattern", SHA256_PATTERN),
    FieldRule("proof", "value_hash", "required"),
    FieldRule("proof", "phase", "pattern", SNAKE_CASE_PATTERN),
]
define(
    "records",
    """
SELECT CAST(sequence AS STRING) AS record_id, CASE query_id WHEN 'signup' THEN 'proof' WHEN 'error' THEN 'letter' ELSE 'event' END AS kind,
  CASE WHEN rowcount % 37 = 0 THEN '2.1' ELSE '1.3' END AS schema_version, CASE WHEN rowcount % 3 > 0 THEN sequence END AS seq, duration_us,
  CASE rowcount % 5 WHEN 0 THEN 'Call' WHEN 1 THEN 'setup' ELSE 'call' END AS phase, CASE WHEN rowcount % 7 = 0 THEN '' ELSE statement END AS statement,
  CASE WHEN rowcount % 4 = 0 THEN concat('sha256:', transaction_id) END AS value_hash
FROM {capture}
""",
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.map_filter(
        F.create_map(
            F.lit("sequence"), F.col("seq").cast("string"),
            F.lit("duration_us"), F.col("duration_us").cast("string"),
            F.lit("phase"), F.col("phase"),
            F.lit("statement"), F.col("statement"),
            F.lit("value_hash"), F.col("value_hash"),
        ),
        lambda _k, v: v.isNotNull(),
    )
    return frame(spark, sf_dir, "records").select("record_id", "kind", "schema_version", fields.alias("fields"))


_REJECTS = f"""rj AS (SELECT record_id, kind, unnest(CASE WHEN schema_version = '2.1' THEN ['unsupported schema version'] ELSE [
      CASE WHEN kind = 'letter' THEN 'unknown record kind' END, CASE WHEN kind = 'event' AND seq IS NULL THEN 'sequence: required' END,
      CASE WHEN kind = 'event' AND duration_us < 500 THEN 'duration_us: at_least 500' END,
      CASE WHEN kind = 'event' AND phase = 'Call' THEN 'phase: one_of (''setup'', ''call'', ''teardown'')' END,
      CASE WHEN kind = 'event' AND statement = '' THEN 'statement: non_empty' END,
      CASE WHEN kind = 'event' AND value_hash IS NOT NULL THEN 'value_hash: pattern {SHA256_PATTERN}' END,
      CASE WHEN kind = 'proof' AND value_hash IS NULL THEN 'value_hash: required' END,
      CASE WHEN kind = 'proof' AND phase = 'Call' THEN 'phase: pattern {SNAKE_CASE_PATTERN}' END] END) AS reason FROM records)"""


@query(
    "q08_record_rejects",
    inputs="records",
    sql=f"WITH {_REJECTS} SELECT * FROM rj WHERE reason IS NOT NULL",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_records(_records(spark, sf_dir), RECORD_RULES)[1]


@query(
    "q08_validate_records",
    inputs="records",
    sql=f"WITH {_REJECTS} SELECT record_id, kind FROM records WHERE record_id NOT IN (SELECT record_id FROM rj WHERE reason IS NOT NULL)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_records(_records(spark, sf_dir), RECORD_RULES)[0].select("record_id", "kind")


@query(
    "q09_stage_cache_key",
    sql="""SELECT doc_id, concat('sha256:', sha256(concat('{"environment_identity":{},"file_hashes":{"app/a.py":"', sha256(text), '","app/b.py":"', sha256(source), '"},"stage_config":{"lang":"', lang, '","source":"', source, '"},"tool_versions":{"tool":"', n_chars, '"},"upstream_hashes":{}}'))) AS cache_key FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Keys are put in out of order: the key must not depend on it.
    maps = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.create_map(F.lit("app/b.py"), F.sha2("source", 256), F.lit("app/a.py"), F.sha2("text", 256)).alias("file_hashes"),
        F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("stage_config"),
        F.create_map(F.lit("tool"), F.col("n_chars").cast("string")).alias("tool_versions"),
        F.lit(None).cast("map<string,string>").alias("upstream_hashes"),
        F.create_map().cast("map<string,string>").alias("environment_identity"),
    )
    return maps.select("doc_id", quality.stage_cache_key().alias("cache_key"))


@query(
    "q09_file_set_digest",
    sql=f"""WITH r AS (SELECT lang AS app_id, sha256(concat('["doc_', doc_id, '","sha256:', sha256(text), '"]')) AS g FROM documents), {trie_sql("app_id")}
    SELECT app_id, concat('sha256:', x) AS digest FROM trie0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.file_set_digest(_files_of(spark, sf_dir, "checkout_files"), ["app_id"])


def _files_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, name).select(
        "app_id", "path", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash")
    )


define("checkout_files", "SELECT lang AS app_id, concat('doc_', doc_id) AS path, text FROM {documents}")
# The next snapshot: some files are gone, some have another text, some are new.
define(
    "later_files",
    """
SELECT lang AS app_id, concat('doc_', doc_id) AS path, CASE WHEN doc_id % 89 = 1 THEN concat(text, '!') ELSE text END AS text FROM {documents} WHERE doc_id % 97 > 0
UNION ALL SELECT lang, concat('new_', doc_id), text FROM {documents} WHERE doc_id % 83 = 2
""",
)


@query(
    "q09_file_set_changes",
    inputs="checkout_files later_files",
    sql="""SELECT app_id, path, CASE WHEN o.text IS NULL THEN 'added' WHEN n.text IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM checkout_files o FULL JOIN later_files n USING (app_id, path) WHERE o.text IS DISTINCT FROM n.text""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (_files_of(spark, sf_dir, name) for name in ("checkout_files", "later_files"))
    return quality.file_set_changes(before, after, ["app_id"])


define(
    "cached_artifacts",
    """
SELECT concat(lang, '/', source) AS app_id, 'schema' AS artifact_type, concat('k', count(*)) AS cache_key FROM {documents} WHERE n_chars > 300 GROUP BY lang, source
UNION ALL SELECT concat(lang, '/', source), 'code', concat('k', count(*)) FROM {documents} WHERE n_chars < 100000 GROUP BY lang, source
""",
)


@query(
    "q10_cache_hits",
    inputs="cached_artifacts",
    sql="""WITH c AS (SELECT concat(lang, '/', source) AS app_id, concat('k', count(*)) AS k FROM documents GROUP BY lang, source)
    SELECT c.app_id, count(DISTINCT artifact_type) = 2 AND bool_and(coalesce(cache_key = k, false)) AS hit FROM c LEFT JOIN cached_artifacts a ON a.app_id = c.app_id GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = (
        table(spark, sf_dir, "documents")
        .groupBy(F.concat_ws("/", "lang", "source").alias("app_id"))
        .agg(F.concat(F.lit("k"), F.count("*")).alias("current_key"))
    )
    return quality.cache_hits(frame(spark, sf_dir, "cached_artifacts"), current)


@query(
    "q11_share_inventory",
    sql="SELECT concat('doc_', doc_id) AS name, strlen(text) AS byte_size, concat('sha256:', sha256(text)) AS content_hash FROM documents",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id").alias("name"), F.col("text").alias("content")
    )
    return quality.share_inventory(files)


define(
    "needles",
    """
SELECT concat('item-', item_id) AS needle_id, text AS needle FROM {benchmark}
UNION ALL SELECT concat('word-', item_id), split_part(text, ' ', 3) FROM {benchmark}
UNION ALL SELECT concat('pair-', item_id), concat(split_part(text, ' ', 4), ' ', split_part(text, ' ', 5)) FROM {benchmark}
UNION ALL SELECT concat('empty-', item_id), '' FROM {benchmark}
""",
)


@query(
    "q12_leak_scan",
    inputs="needles",
    sql="SELECT doc_id AS text_id, needle_id FROM documents JOIN needles ON needle <> '' AND contains(text, needle)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return quality.leak_scan(texts, frame(spark, sf_dir, "needles"))


# Needles of one common beginning and without an inner word.
define(
    "prefixed_needles",
    " UNION ALL ".join(
        f"SELECT concat('{n}-', item_id) AS needle_id, concat('e ', split_part(text, ' ', {n})) AS needle FROM {{benchmark}}"
        for n in range(1, 7)
    ),
)


@query(
    "q12_leak_scan_shared_prefix",
    inputs="prefixed_needles",
    sql="SELECT doc_id AS text_id, needle_id FROM documents JOIN prefixed_needles ON contains(text, needle)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return quality.leak_scan(texts, frame(spark, sf_dir, "prefixed_needles"))


define(
    "stage_events",
    """
SELECT concat('run-', user_id) AS run_id, CASE k % 4 WHEN 0 THEN 'query_capture' WHEN 1 THEN 'dataset_build' WHEN 2 THEN 'context_resolution' ELSE 'report_generation' END AS stage,
  CASE event_type WHEN 'purchase' THEN 'running' WHEN 'click' THEN 'complete' WHEN 'view' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'cancelled' END AS status,
  event_id AS pos, ts AS at_time, CASE WHEN k > 40 THEN props END AS detail
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM {events}) e
""",
)


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "stage_events").withColumnRenamed("at_time", "at")


TRANSITIONS_SQL = """WITH l AS (SELECT run_id, stage, pos, status, coalesce(lag(status) OVER (PARTITION BY run_id, stage ORDER BY pos), 'pending') AS previous FROM stage_events)
    SELECT *, (previous = 'pending' AND status IN ('running', 'cancelled')) OR (previous = 'running' AND status IN ('complete', 'partial', 'failed', 'cancelled')) AS legal FROM l"""


@query("q13_stage_transitions", inputs="stage_events", sql=TRANSITIONS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.stage_transitions(stage_log(spark, sf_dir), width=512).drop("at", "detail")


@query(
    "q14_stage_summaries",
    inputs="stage_events",
    sql="""WITH g AS (SELECT run_id, stage, arg_min(at_time, pos) AS started_at, arg_max(status, pos) AS status, max(at_time) FILTER (WHERE status <> 'x') AS last_at, first(detail ORDER BY pos DESC) AS detail, arg_max(at_time, pos) AS la FROM stage_events GROUP BY ALL)
    SELECT run_id, stage, status, detail, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS started_at, CASE WHEN status <> 'running' THEN strftime(la, '%Y-%m-%dT%H:%M:%S.%fZ') END AS ended_at,
      CASE WHEN status <> 'running' THEN epoch_us(la) - epoch_us(started_at) END AS duration_us,
      CASE WHEN status = 'failed' AND detail IS NULL THEN 'a failed stage must state its failure reason' WHEN status = 'partial' AND detail IS NULL THEN 'a partial stage must state its boundary explicitly' END AS problem FROM g""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:


    summaries = quality.stage_summaries(stage_log(spark, sf_dir))
    return summaries.withColumn("started_at", rfc3339("started_at")).withColumn(
        "ended_at", rfc3339("ended_at")
    )


@query(
    "q15_schema_compat",
    inputs="doc_artifacts",
    sql="""SELECT doc_id, schema_version, CASE WHEN schema_version <> '01.3' THEN CAST(split_part(schema_version, '.', 1) AS BIGINT) END AS major,
      CASE WHEN schema_version <> '01.3' THEN CAST(split_part(schema_version, '.', 2) AS BIGINT) END AS minor, schema_version IN ('1.3', '1.9') AS compatible FROM doc_artifacts""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.schema_compat(
        frame(spark, sf_dir, "doc_artifacts").select("doc_id", "schema_version")
    )


# --- files and catalogs ----------------------------------------------------------------------

define(
    "checkout_paths",
    """
SELECT lang AS app_id, doc_id, CASE n_chars % 12 WHEN 0 THEN concat('.git/objects/', doc_id) WHEN 1 THEN concat('src/.env.', doc_id) WHEN 2 THEN concat('lib/x', doc_id, '.pyc')
  WHEN 3 THEN concat('pkg.egg-info/', doc_id) WHEN 4 THEN concat('a/node_modules/.git/', doc_id) ELSE concat('app/doc_', doc_id, '.py') END AS path, text
FROM {documents}
""",
)


@query(
    "c04_file_inventory",
    inputs="checkout_paths",
    sql="""WITH RECURSIVE f AS (SELECT app_id, path, strlen(text) AS size, CASE WHEN starts_with(path, '.git/') THEN 'excluded: .git/' WHEN starts_with(path, 'src/.env') THEN concat('excluded: ', substr(path, 5)) WHEN ends_with(path, '.pyc') THEN 'excluded: .pyc file'
        WHEN starts_with(path, 'pkg.egg') THEN 'excluded: pkg.egg-info/' WHEN starts_with(path, 'a/node') THEN 'excluded: node_modules/' WHEN strlen(text) > 6000 THEN concat('file too large (', strlen(text), ' bytes, limit 6000)') END AS reason FROM checkout_paths),
    n AS (SELECT app_id, path, size, row_number() OVER (PARTITION BY app_id ORDER BY path) AS i FROM f WHERE reason IS NULL),
    w(app_id, i, total, taken, path) AS (SELECT app_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), true, '' FROM (SELECT DISTINCT app_id FROM n) a
      UNION ALL SELECT w.app_id, n.i, CASE WHEN w.total + n.size <= 40000 THEN w.total + n.size ELSE w.total END, w.total + n.size <= 40000, n.path FROM w JOIN n ON n.app_id = w.app_id AND n.i = w.i + 1)
    SELECT f.app_id, f.path, f.size, coalesce(f.reason, CASE WHEN NOT w.taken THEN 'total size limit reached' END) AS reason FROM f LEFT JOIN w ON w.app_id = f.app_id AND w.path = f.path""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frame(spark, sf_dir, "checkout_paths").select(
        "app_id", "path", F.octet_length("text").cast("long").alias("size")
    )
    return file_source.file_inventory(files, max_file=6000, max_total=40000)


define(
    "code_files",
    """
SELECT concat('app-', CAST(floor(doc_id / 4) AS BIGINT)) AS app_id, CASE n_chars % 11 WHEN 0 THEN 'db/env.py' WHEN 1 THEN 'db/versions/x.py' WHEN 2 THEN 'tests/conftest.py' WHEN 3 THEN 'deploy/Dockerfile'
  WHEN 4 THEN concat('pkg_', source, '/__init__.py') WHEN 5 THEN 'src/core/__init__.py' WHEN 6 THEN 'alembic.ini' WHEN 7 THEN concat('app/test_', doc_id, '.py') WHEN 8 THEN CASE WHEN doc_id % 4 = 0 THEN 'pyproject.toml' ELSE 'docs/pyproject.toml' END ELSE concat('app/m_', doc_id, '.py') END AS path,
  CASE WHEN n_chars % 11 = 8 THEN concat('[project]', chr(10), 'version = "1"', chr(10), 'name = "pkg-', source, '"') ELSE CASE n_chars % 5 WHEN 0 THEN 'from sqlalchemy.orm import Session' WHEN 1 THEN 'import os, sqlmodel as s' WHEN 2 THEN 'import json.tool' ELSE 'x = 1 # import sqlalchemy' END END AS head, source, text
FROM {documents}
""",
)


@query(
    "c05_framework_signals",
    inputs="code_files",
    sql="""WITH f AS (SELECT *, ends_with(path, '.py') AS py, regexp_extract(path, '[^/]*$') AS name FROM code_files)
    SELECT app_id, coalesce(bool_or(name = 'env.py') AND bool_or(path = 'db/versions/x.py'), false) OR bool_or(name = 'alembic.ini') AS uses_alembic,
      CASE WHEN bool_or(name = 'env.py') AND bool_or(path = 'db/versions/x.py') THEN 'db' ELSE '' END AS alembic_directories,
      bool_or(py AND contains(head, 'from sqlalchemy')) AS uses_sqlalchemy, bool_or(py AND contains(head, 'sqlmodel')) AS uses_sqlmodel,
      bool_or(starts_with(name, 'test_') OR starts_with(path, 'tests/')) AS has_tests, coalesce(string_agg(DISTINCT path, ',') FILTER (WHERE name = 'Dockerfile'), '') AS docker_files,
      coalesce(string_agg(DISTINCT CASE WHEN starts_with(path, 'src/') THEN 'core' ELSE split_part(path, '/', 1) END, ',' ORDER BY CASE WHEN starts_with(path, 'src/') THEN 'core' ELSE split_part(path, '/', 1) END) FILTER (WHERE name = '__init__.py'), '') AS likely_app_roots, max(concat('pkg-', source)) FILTER (WHERE path = 'pyproject.toml') AS package_name FROM f GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frame(spark, sf_dir, "code_files").select(
        "app_id", "path", F.concat_ws("\n# ", "head", F.regexp_replace("text", "\\s+", " ")).alias("source")
    )
    found = file_source.framework_signals(files)
    lists = ("alembic_directories", "docker_files", "likely_app_roots")
    return found.withColumns({name: F.array_join(name, ",") for name in lists})


define("raw_extensions", "SELECT DISTINCT app_id, concat('ext_', rf) AS name, concat('1.', ln) AS version FROM {catalog_lines} WHERE qty > 40")
define("raw_settings", "SELECT app_id, concat('setting_', ls) AS name, CAST(max(ln) AS STRING) AS value FROM {catalog_lines} WHERE qty < 30 GROUP BY app_id, ls")


@query(
    "c03_server_facts",
    inputs="raw_extensions raw_settings",
    sql="""WITH e AS (SELECT app_id, string_agg(concat(name, '=', version), ',' ORDER BY name, version) AS extensions FROM raw_extensions GROUP BY 1), s AS (SELECT app_id, string_agg(concat(name, '=', value), ',' ORDER BY name) AS settings FROM raw_settings GROUP BY 1),
    h AS (SELECT concat('app-', s_suppkey) AS app_id, concat('rev-', s_nationkey) AS migration_head FROM supplier WHERE s_acctbal > 0)
    SELECT app_id, extensions, settings, migration_head FROM e FULL JOIN s USING (app_id) LEFT JOIN h USING (app_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "supplier").where("s_acctbal > 0").selectExpr(
        "concat('app-', s_suppkey) AS app_id", "concat('rev-', s_nationkey) AS migration_head"
    )
    facts = catalog_source.server_facts(
        frame(spark, sf_dir, "raw_extensions"), frame(spark, sf_dir, "raw_settings"), heads
    )

    def listed(name: str, value: str):
        return F.array_join(F.transform(name, lambda e: F.concat_ws("=", e["name"], e[value])), ",")

    return facts.withColumn("extensions", listed("extensions", "version")).withColumn(
        "settings", listed("settings", "value")
    )


# Raw catalog views: each supplier is one database, its lines are relations, keys and indexes.
define(
    "raw_relations",
    """
SELECT app_id, CASE WHEN ln = 7 AND ordinal = 0 THEN 'pg_catalog' ELSE 'public' END AS schema_name, table_name AS name,
  CASE WHEN min(qty) > 45 THEN 'v' WHEN max(tax) > 0.07 AND ordinal = 3 THEN 'p' ELSE 'r' END AS relkind, CASE WHEN min(qty) < 5 THEN 'small' END AS comment
FROM (SELECT app_id, table_name, min(ln) AS ln, min(ordinal) AS ordinal, min(qty) AS qty, max(tax) AS tax FROM {catalog_lines} GROUP BY app_id, table_name) g GROUP BY app_id, table_name, ln, ordinal
""",
)
define(
    "raw_constraint_keys",
    """
SELECT app_id, 'public' AS schema_name, table_name, concat(table_name, '_', CASE WHEN rf = 'A' THEN 'u' ELSE 'f' END, ln % 3) AS constraint_name,
  CASE WHEN rf = 'A' THEN 'u' ELSE 'f' END AS contype, min(place) AS ord, name AS column_name, CASE WHEN rf <> 'A' THEN 'public' END AS ref_schema,
  CASE WHEN rf <> 'A' THEN concat('t', ln % 3) END AS ref_table, CASE WHEN rf <> 'A' THEN name END AS ref_column, CASE WHEN ln % 3 = 1 THEN 'c' ELSE 'a' END AS delete_code
FROM {catalog_lines} WHERE rf <> 'N' GROUP BY app_id, table_name, rf, ln % 3, name
""",
)
define(
    "raw_index_keys",
    """
SELECT app_id, 'public' AS schema_name, table_name, concat('ix_', table_name, '_', ln) AS index_name, 'btree' AS method, max(disc) > 0.09 AS is_unique, ln = 1 AS is_primary,
  CASE WHEN ln < 4 THEN concat(table_name, '_u', ln % 3) END AS constraint_name, min(ordinal) AS ord, CASE WHEN min(ordinal) <> 4 THEN min(name) END AS column_name, CASE WHEN min(ordinal) = 4 THEN 'lower(c4)' END AS expression, min(tax) > 0.04 AS is_descending
FROM {catalog_lines} WHERE rf = 'N' GROUP BY app_id, table_name, ln
""",
)


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    attributes = frame(spark, sf_dir, "phys_columns").selectExpr(
        "app_id", "'public' AS schema_name", "table_name", "name", "data_type", "nullable", "default_expression",
        "false AS is_identity", "false AS is_generated", "ordinal AS ord",
    )
    constraint_keys = frame(spark, sf_dir, "raw_constraint_keys").withColumn(
        "definition", F.lit(None).cast("string")
    )
    indexes = frame(spark, sf_dir, "raw_index_keys").withColumn("predicate", F.lit(None).cast("string"))
    return catalog_source.read_catalog(
        frame(spark, sf_dir, "raw_relations"), attributes, constraint_keys, indexes
    )


_OWN = "own AS (SELECT app_id, name AS table_name, comment FROM raw_relations WHERE relkind = 'r' AND schema_name = 'public')"


@query(
    "c03_read_catalog",
    inputs="raw_relations raw_constraint_keys raw_index_keys phys_columns",
    sql=f"""WITH {_OWN}, uq AS (SELECT DISTINCT app_id, constraint_name FROM raw_constraint_keys WHERE contype = 'u' AND (app_id, table_name) IN (SELECT app_id, table_name FROM own))
    SELECT app_id, 'table' AS part, concat('public.', table_name) AS id, coalesce(comment, '') AS detail FROM own
    UNION ALL SELECT app_id, 'unsupported', CASE relkind WHEN 'v' THEN 'view' ELSE 'partitioned_table' END, concat(schema_name, '.', name, ': not a supported relation kind') FROM raw_relations WHERE relkind <> 'r' AND schema_name = 'public'
    UNION ALL SELECT app_id, 'column', column_id, concat(data_type, ' ', nullable) FROM phys_columns WHERE (app_id, table_name) IN (SELECT app_id, table_name FROM own)
    UNION ALL SELECT app_id, 'constraint', constraint_name, concat(max(CASE contype WHEN 'u' THEN 'unique' ELSE 'foreign_key' END), ':', string_agg(concat('public.', table_name, '.', column_name), ',' ORDER BY ord, column_name), '>', coalesce(string_agg(CASE WHEN ref_table IS NOT NULL THEN concat(ref_schema, '.', ref_table, '.', ref_column) END, ',' ORDER BY ord, column_name), ''),
        coalesce(max(CASE WHEN contype = 'f' THEN CASE delete_code WHEN 'c' THEN ' cascade' ELSE ' no_action' END END), '')) FROM raw_constraint_keys WHERE (app_id, table_name) IN (SELECT app_id, table_name FROM own) GROUP BY app_id, constraint_name
    UNION ALL SELECT app_id, 'index', index_name, concat(is_unique, ':', CASE WHEN column_name IS NOT NULL THEN concat('public.', table_name, '.', column_name) ELSE expression END, CASE WHEN is_descending THEN ' desc' ELSE ' asc' END) FROM raw_index_keys
      WHERE (app_id, table_name) IN (SELECT app_id, table_name FROM own) AND NOT is_primary AND (constraint_name IS NULL OR (app_id, constraint_name) NOT IN (SELECT app_id, constraint_name FROM uq))""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _catalog(spark, sf_dir)

    def rows(part: str, name: str, identity: str, detail) -> DataFrame:
        return parts[name].select("app_id", F.lit(part).alias("part"), F.col(identity).alias("id"), detail.alias("detail"))

    keys = F.transform(
        "keys", lambda k: F.concat(F.coalesce(k["column"], k["expression"]), F.lit(" "), k["direction"])
    )
    constraint = F.concat(
        "kind",
        F.lit(":"),
        F.array_join("columns", ","),
        F.lit(">"),
        F.array_join("referenced_columns", ","),
        F.coalesce(F.concat(F.lit(" "), "on_delete"), F.lit("")),
    )
    return (
        rows("table", "tables", "table_id", F.coalesce("comment", F.lit("")))
        .unionByName(rows("unsupported", "unsupported", "kind", F.col("reason")))
        .unionByName(rows("column", "columns", "column_id", F.concat_ws(" ", "data_type", F.col("nullable").cast("string"))))
        .unionByName(rows("constraint", "constraints", "name", constraint))
        .unionByName(rows("index", "indexes", "name", F.concat(F.col("is_unique").cast("string"), F.lit(":"), F.array_join(keys, ","))))
    )
