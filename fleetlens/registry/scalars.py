"""Scalar functions over the string columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import identity as i
from fleetlens.registry.base import query
from fleetlens.registry.inputs import define, frame, table

define(
    "type_texts",
    """
SELECT p_partkey, concat(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END, CASE p_partkey % 11 WHEN 0 THEN 'Numeric' WHEN 1 THEN 'character varying' WHEN 2 THEN 'BIGINT' WHEN 3 THEN 'timestamp without time zone'
  WHEN 4 THEN 'bool' WHEN 5 THEN 'jsonb' WHEN 6 THEN 'integer[]' WHEN 7 THEN 'date' WHEN 8 THEN 'double precision' WHEN 9 THEN 'varchar' ELSE 'Decimal' END,
  CASE p_partkey % 11 WHEN 0 THEN concat('(', p_size, ',2)') WHEN 1 THEN concat('( ', p_size, ' )') WHEN 9 THEN concat('(', p_size, ')') WHEN 10 THEN concat(' (', p_size, ' , 4)') ELSE '' END) AS data_type
FROM {part}
""",
)
_BASE = "lower(trim(regexp_replace(data_type, '\\(\\s*\\d+\\s*(,\\s*\\d+\\s*)?\\)', '')))"


@query(
    "s01_base_type",
    inputs="type_texts",
    sql=f"SELECT p_partkey, {_BASE} AS base_type, lower(trim(split_part(data_type, '(', 1))) AS comparison_type FROM type_texts",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "type_texts").select(
        "p_partkey",
        i.base_type("data_type").alias("base_type"),
        i.comparison_type("data_type").alias("comparison_type"),
    )


@query(
    "s02_type_family",
    inputs="type_texts",
    sql=f"""SELECT p_partkey, CASE WHEN {_BASE} = 'bigint' THEN 'integer' WHEN {_BASE} IN ('numeric', 'decimal', 'double precision') THEN 'numeric' WHEN {_BASE} IN ('character varying', 'varchar') THEN 'text'
      WHEN {_BASE} = 'bool' THEN 'boolean' WHEN {_BASE} IN ('date', 'timestamp without time zone') THEN 'timestamp' END AS family FROM type_texts""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "type_texts").select(
        "p_partkey", i.type_family("data_type").alias("family")
    )


@query("s03_value_hash", sql="SELECT doc_id, concat('sha256:', sha256(text)) AS value_hash FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", i.sha256_text("text").alias("value_hash"))


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(
    "s04_split_text",
    sql=f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {_STRIP.format("x")}), lambda x: x <> ''), '|') AS parts,
      CASE WHEN contains(text, ',') AND {_STRIP.format("substr(text, instr(text, ',') + 1)")} <> '' THEN {_STRIP.format("split_part(text, ',', 1)")} ELSE {_STRIP.format("text")} END AS first,
      CASE WHEN contains(text, ',') AND {_STRIP.format("substr(text, instr(text, ',') + 1)")} <> '' THEN {_STRIP.format("substr(text, instr(text, ',') + 1)")} END AS second FROM conversations""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = i.split_two("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(i.split_list("text"), "|").alias("parts"),
        two["first"].alias("first"),
        two["second"].alias("second"),
    )


@query("s05_safe_id", sql="SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS safe_id FROM pages")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", i.safe_id("url").alias("safe_id"))


define(
    "path_texts",
    """
SELECT page_id, CASE page_id % 9 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', '') WHEN 2 THEN concat('/', page_id, '/a.py') WHEN 3 THEN concat('app/../', page_id) WHEN 4 THEN concat('C:', page_id)
  WHEN 5 THEN concat('~/', page_id) WHEN 6 THEN concat('app/', page_id, '/') WHEN 7 THEN concat('app/./', page_id) ELSE concat('app/m', page_id, '.py') END AS path
FROM {pages}
""",
)


@query(
    "s06_path_check",
    inputs="path_texts",
    sql="""SELECT page_id, path, length(path) > 0 AND NOT contains(path, '//') AND NOT starts_with(path, '/') AND NOT ends_with(path, '/') AND NOT starts_with(path, '~') AND NOT regexp_matches(path, '^[A-Za-z]:')
      AND NOT regexp_matches(path, '(^|/)\\.\\.?(/|$)') AND NOT contains(path, '\\') AS valid FROM path_texts""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "path_texts").select(
        "page_id", "path", i.is_repository_path("path").alias("valid")
    )


_ENC = "replace(replace({0}, '\\', '\\\\'), '.', '\\.')"


@query(
    "s07_encode_identity",
    sql=f"SELECT doc_id, concat({_ENC.format('source')}, '.', {_ENC.format('text')}) AS identity FROM documents",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", i.encode_identity("source", "text").alias("identity")
    )


@query(
    "s08_decode_identity",
    sql="SELECT doc_id, source AS schema_name, text AS table_name, doc_id % 5 <> 0 AS decoded FROM documents".replace(
        "source AS schema_name, text AS table_name", "CASE WHEN doc_id % 5 <> 0 THEN source END AS schema_name, CASE WHEN doc_id % 5 <> 0 THEN text END AS table_name"
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every fifth identity ends with a dangling escape and must be refused.
    whole = i.encode_identity("source", "text")
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(whole, F.lit("\\"))).otherwise(whole)
    names = i.decode_identity(F.col("identity"))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", broken.alias("identity"))
        .select(
            "doc_id",
            F.get(names, F.lit(0)).alias("schema_name"),
            F.get(names, F.lit(1)).alias("table_name"),
            names.isNotNull().alias("decoded"),
        )
    )


@query(
    "s09_frame_components",
    sql="SELECT doc_id, concat('[\"edge\",', to_json(source), ',', to_json(text), ',', n_chars, ',[', to_json(lang), ',\"x\"]]') AS framed, text AS third FROM documents",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        i.frame_components(
            F.lit("edge"), "source", "text", "n_chars", F.array("lang", F.lit("x"))
        ).alias("framed"),
    ).withColumn("third", F.get(i.unframe_components("framed"), F.lit(2)))


@query(
    "s10_canonical_hash",
    sql="""SELECT d.doc_id, concat('sha256:', sha256(concat('{"lang":', to_json(lang), ',"n_chars":', n_chars, ',"quality":', CASE WHEN quality IS NULL THEN 'null' ELSE CAST(quality AS VARCHAR) END, ',"text":', to_json(text), '}'))) AS content_hash
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", i.canonical_hash("text", "quality", "n_chars", "lang").alias("content_hash"))


@query("s11_rfc3339", sql="SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS moment FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", i.rfc3339("ts").alias("moment"))


@query(
    "s12_node_operation_proof_ids",
    sql="""SELECT event_id, CASE WHEN event_type <> 'error' THEN concat(event_type, ':', props) END AS node, CASE WHEN event_type <> 'error' THEN event_type END AS kind, CASE WHEN event_type <> 'error' THEN props END AS key,
      concat('pytest::["test_', user_id, '","call"]') AS operation, CASE WHEN user_id > 9 THEN concat('IDX-', lpad(CAST(user_id AS VARCHAR), 3, '0'), '@sha256:', sha256(props)) END AS proof FROM events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", F.lit("bad:kind")).otherwise(F.col("event_type"))
    finding = F.concat(
        F.when(F.col("user_id") > 9, "IDX-").otherwise("idx-"), F.lpad(F.col("user_id").cast("string"), 3, "0")
    )
    parts = i.node_parts(F.col("node"))
    return (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            i.node_id(kind, "props").alias("node"),
            i.operation_id("pytest", F.concat(F.lit("test_"), "user_id"), F.lit("call")).alias("operation"),
            i.proof_id(finding, i.sha256_text("props")).alias("proof"),
        )
        .select("event_id", "node", "operation", "proof", parts["kind"].alias("kind"), parts["key"].alias("key"))
    )
