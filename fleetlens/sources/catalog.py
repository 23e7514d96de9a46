"""Database catalogs as snapshot tables, many databases at once.

Raw frames carry app_id and mirror the catalog views: relations (schema_name, name, relkind,
comment), attributes (schema_name, table_name, name, data_type, nullable, default_expression,
is_identity, is_generated, ord), constraint keys (schema_name, table_name, constraint_name,
contype, ord, column_name, ref_schema, ref_table, ref_column, delete_code, definition) and index keys
(schema_name, table_name, index_name, method, is_unique, is_primary, constraint_name, predicate,
ord, column_name, expression, is_descending).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.identity import encode_identity, table_id

# Catalog codes.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]
RELATION_KINDS = {
    "v": "view",
    "m": "materialized_view",
    "f": "foreign_table",
    "p": "partitioned_table",
    "c": "composite_type",
}
CONSTRAINT_KINDS = {
    "p": "primary_key",
    "f": "foreign_key",
    "u": "unique",
    "c": "check",
    "x": "exclusion",
}
ACTIONS = {"a": "no_action", "r": "restrict", "c": "cascade", "n": "set_null", "d": "set_default"}


def _decode(codes: dict[str, str], name: str):
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.try_element_at(table, F.col(name))


def jdbc_snapshot(spark: SparkSession, url: str, view: str, **options: str) -> DataFrame:
    """One catalog view of a live database, to be written as a snapshot table."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", view).options(**options).load()


def read_catalog(
    relations: DataFrame, attributes: DataFrame, constraint_keys: DataFrame, index_keys: DataFrame
) -> dict[str, DataFrame]:
    """tables, columns, constraints, indexes and unsupported relations of each database.

    Indexes behind a primary key or unique constraint are constraints only. Key lists are as
    long as one key.
    """
    visible = relations.where(~F.col("schema_name").isin(SYSTEM_SCHEMAS))
    identity = table_id("schema_name", "name")
    tables = visible.where("relkind = 'r'").select(
        "app_id", identity.alias("table_id"), "schema_name", "name", "comment"
    )
    unsupported = visible.where(F.col("relkind").isin(list(RELATION_KINDS))).select(
        "app_id",
        _decode(RELATION_KINDS, "relkind").alias("kind"),
        F.concat("schema_name", F.lit("."), "name", F.lit(": not a supported relation kind")).alias("reason"),
    )
    own = ["app_id", "table_id"]

    def of_tables(frame: DataFrame) -> DataFrame:
        keyed = frame.withColumn("table_id", table_id("schema_name", "table_name"))
        return keyed.join(tables.select(*own), own, "left_semi")

    columns = of_tables(attributes).select(
        *own,
        encode_identity("schema_name", "table_name", "name").alias("column_id"),
        "name",
        "data_type",
        "nullable",
        "default_expression",
        "is_identity",
        "is_generated",
        F.col("ord").alias("ordinal"),
    )
    column = encode_identity("schema_name", "table_name", "column_name")
    reference = encode_identity("ref_schema", "ref_table", "ref_column")
    keys = of_tables(constraint_keys).select(
        *own,
        F.col("constraint_name").alias("name"),
        _decode(CONSTRAINT_KINDS, "contype").alias("kind"),
        F.when(F.col("ref_table").isNotNull(), table_id("ref_schema", "ref_table")).alias("referenced_table"),
        F.when(F.col("contype") == "f", _decode(ACTIONS, "delete_code")).alias("on_delete"),
        F.when(F.col("contype") == "c", F.regexp_replace("definition", r"^CHECK \((.*)\)$", "$1")).alias("expression"),
        "ord",
        F.when(F.col("column_name").isNotNull(), column).alias("column_id"),
        F.when(F.col("ref_column").isNotNull(), reference).alias("ref_id"),
    )
    listed = F.array_sort(F.collect_list(F.struct("ord", "column_id", "ref_id")))
    constraints = (
        keys.groupBy(*own, "name", "kind", "referenced_table", "on_delete", "expression")
        .agg(listed.alias("_keys"))
        .withColumn("columns", F.array_compact(F.col("_keys.column_id")))
        .withColumn("referenced_columns", F.array_compact(F.col("_keys.ref_id")))
        .drop("_keys")
    )
    backing = constraints.where("kind = 'unique'").select(*own, F.col("name").alias("constraint_name"))
    free = (
        of_tables(index_keys)
        .where("NOT is_primary")
        .join(backing, [*own, "constraint_name"], "left_anti")
    )
    key = F.struct(
        F.when(F.col("column_name").isNotNull(), column).alias("column"),
        "expression",
        F.when(F.col("is_descending"), "desc").otherwise("asc").alias("direction"),
    )
    indexes = (
        free.groupBy(*own, F.col("index_name").alias("name"), "method", "is_unique", "predicate")
        .agg(F.array_sort(F.collect_list(F.struct("ord", key.alias("key")))).alias("_keys"))
        .withColumn("keys", F.col("_keys.key"))
        .drop("_keys")
    )
    return {
        "tables": tables,
        "columns": columns,
        "constraints": constraints,
        "indexes": indexes,
        "unsupported": unsupported,
    }


def server_facts(extensions: DataFrame, settings: DataFrame, heads: DataFrame) -> DataFrame:
    """(app_id, extensions, settings, migration_head) of each database."""
    e = extensions.groupBy("app_id").agg(
        F.array_sort(F.collect_set(F.struct("name", "version"))).alias("extensions")
    )
    s = settings.groupBy("app_id").agg(
        F.array_sort(F.collect_set(F.struct("name", "value"))).alias("settings")
    )
    return e.join(s, "app_id", "full_outer").join(
        heads.select("app_id", "migration_head"), "app_id", "left"
    )
