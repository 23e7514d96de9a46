"""Reconciliation of a physical catalog with declared models, per application.

Catalog frames: tables (app_id, table_id, schema_name, name), columns (app_id, table_id,
column_id, name, data_type, nullable, ordinal, ...), constraints (app_id, table_id, name, kind,
columns, referenced_table, referenced_columns, ordinal, ...). All joins are on
(app_id, object id), so one large application spreads over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.identity import identity_part, frame_components

MISSING = "model_references_missing_physical_object"
UNDECLARED = "physical_object_absent_from_models"
NULLABILITY = "mismatched_nullability"
DECLARED_ONLY = "orm_only_relationship"
PHYSICAL_ONLY = "physical_fk_without_orm_relationship"


def _table_name(table_id: Column) -> Column:
    return identity_part(table_id, 2)


def _python_bool(value: Column) -> Column:
    return F.initcap(value.cast("string"))


def reconcile_tables(physical: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables declared but missing, and present but undeclared."""
    keys = ["app_id", "table_id"]
    left = declared.select(*keys, F.col("name").alias("declared_name"))
    right = physical.select(*keys, F.col("name").alias("physical_name"))
    missing = F.col("physical_name").isNull()
    return (
        left.join(right, keys, "full_outer")
        .where("declared_name IS NULL OR physical_name IS NULL")
        .select(
            "app_id",
            F.when(missing, MISSING).otherwise(UNDECLARED).alias("kind"),
            F.array("table_id").alias("objects"),
            F.when(
                missing,
                F.concat("declared_name", F.lit(": declared by the ORM but not created by any migration")),
            )
            .otherwise(
                F.concat("physical_name", F.lit(": created by a migration but not declared by any ORM model"))
            )
            .alias("summary"),
        )
    )


def key_columns(*constraints: DataFrame) -> DataFrame:
    """(app_id, column_id) of every primary-key column on any side."""
    frames = [
        c.where("kind = 'primary_key'").select("app_id", F.explode("columns").alias("column_id"))
        for c in constraints
    ]
    result = frames[0]
    for other in frames[1:]:
        result = result.unionByName(other)
    return result.distinct()


def reconcile_columns(
    physical: DataFrame,
    declared: DataFrame,
    physical_tables: DataFrame,
    declared_tables: DataFrame,
    keys: DataFrame,
) -> DataFrame:
    """Column differences of the tables both sides have; key columns skip nullability."""
    shared = physical_tables.select("app_id", "table_id", "name").join(
        declared_tables.select("app_id", "table_id"), ["app_id", "table_id"]
    )
    on = ["app_id", "table_id", "column_id"]
    left = declared.select(*on, F.struct("name", "nullable").alias("d"))
    right = physical.select(*on, F.struct("name", "nullable").alias("p"))
    joined = (
        left.join(right, on, "full_outer")
        .join(shared.withColumnRenamed("name", "table_name"), ["app_id", "table_id"])
        .join(keys.withColumn("is_key", F.lit(True)), ["app_id", "column_id"], "left")
    )
    d, p = F.col("d"), F.col("p")
    where = F.concat("table_name", F.lit("."), F.coalesce(d["name"], p["name"]))
    kind = (
        F.when(p.isNull(), MISSING)
        .when(d.isNull(), UNDECLARED)
        .when(F.col("is_key").isNull() & (d["nullable"] != p["nullable"]), NULLABILITY)
    )
    summary = (
        F.when(p.isNull(), F.concat(where, F.lit(": declared by the ORM but not created by any migration")))
        .when(
            d.isNull(),
            F.concat(where, F.lit(": created by a migration but not declared by any ORM model")),
        )
        .otherwise(
            F.concat(
                where,
                F.lit(": the ORM declares nullable="),
                _python_bool(d["nullable"]),
                F.lit(", the migration creates nullable="),
                _python_bool(p["nullable"]),
            )
        )
    )
    return joined.select(
        "app_id", kind.alias("kind"), F.array("column_id").alias("objects"), summary.alias("summary")
    ).where("kind IS NOT NULL")


def foreign_key_pairs(constraints: DataFrame) -> DataFrame:
    """First foreign key per (app_id, source_table, target_table)."""
    return (
        constraints.where("kind = 'foreign_key' AND referenced_table IS NOT NULL")
        .groupBy(
            "app_id",
            F.col("table_id").alias("source_table"),
            F.col("referenced_table").alias("target_table"),
        )
        .agg(F.min(F.struct("ordinal", "name")).alias("first"))
    )


def holding_relationships(relationships: DataFrame) -> DataFrame:
    """First many-to-one relationship per (app_id, source_table, target_table)."""
    return (
        relationships.where("cardinality = 'many_to_one'")
        .groupBy("app_id", "source_table", "target_table")
        .agg(F.min(F.struct("ordinal", "name")).alias("first"))
    )


def reconcile_relationships(constraints: DataFrame, relationships: DataFrame) -> DataFrame:
    """Declared relationships no foreign key backs, and foreign keys nothing declares."""
    pair = ["app_id", "source_table", "target_table"]
    keys, declared = foreign_key_pairs(constraints), holding_relationships(relationships)
    ends = (
        _table_name(F.col("source_table")),
        F.lit(" to "),
        _table_name(F.col("target_table")),
    )
    objects = F.array("source_table", "target_table").alias("objects")
    declared_only = declared.join(keys, pair, "left_anti").select(
        "app_id",
        F.lit(DECLARED_ONLY).alias("kind"),
        objects,
        F.concat(
            F.col("first.name"),
            F.lit(": the ORM declares a relationship from "),
            *ends,
            F.lit(", but no physical foreign key backs it"),
        ).alias("summary"),
        F.col("first.ordinal").alias("ordinal"),
    )
    physical_only = keys.join(declared, pair, "left_anti").select(
        "app_id",
        F.lit(PHYSICAL_ONLY).alias("kind"),
        objects,
        F.concat(
            F.col("first.name"),
            F.lit(": a physical foreign key exists from "),
            *ends,
            F.lit(", but no ORM relationship declares it"),
        ).alias("summary"),
        F.col("first.ordinal").alias("ordinal"),
    )
    return declared_only.unionByName(physical_only)


def evidence_id(kind: Column, objects: Column) -> Column:
    return frame_components(F.lit("reconciliation"), kind, objects)


def reconcile(
    physical: dict[str, DataFrame], declared: dict[str, DataFrame], relationships: DataFrame
) -> DataFrame:
    """All observations (app_id, kind, objects, summary, evidence_id).

    Both sides are dicts with `tables`, `columns` and `constraints`.
    """
    keys = key_columns(physical["constraints"], declared["constraints"])
    parts = (
        reconcile_tables(physical["tables"], declared["tables"]),
        reconcile_columns(
            physical["columns"], declared["columns"], physical["tables"], declared["tables"], keys
        ),
        reconcile_relationships(physical["constraints"], relationships).drop("ordinal"),
    )
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.withColumn("evidence_id", evidence_id(F.col("kind"), F.col("objects")))


def evidence_for_objects(observations: DataFrame) -> DataFrame:
    """(app_id, object_id, evidence_id): distinct evidence of each object, one row per citation."""
    return observations.select(
        "app_id", F.explode("objects").alias("object_id"), "evidence_id"
    ).distinct()


def stale_evidence(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence whose recorded hash is present and differs from the file's current one."""
    current = files.select("app_id", "path", F.col("content_hash").alias("current_hash"))
    return evidence.where("content_hash IS NOT NULL").join(current, ["app_id", "path"]).where(
        "content_hash <> current_hash"
    )


def merge_columns(physical: DataFrame, declared: DataFrame, physical_tables: DataFrame) -> DataFrame:
    """Columns of the merged schema: a table both sides have takes the physical columns only."""
    only_declared = declared.join(
        physical_tables.select("app_id", "table_id"), ["app_id", "table_id"], "left_anti"
    )
    return physical.withColumn("side", F.lit("physical")).unionByName(
        only_declared.withColumn("side", F.lit("declared"))
    )


def head_matched(apps: DataFrame) -> DataFrame:
    """Add `matched`: live head equals the expected one, true when none is expected."""
    return apps.withColumn(
        "matched", F.col("expected_head").isNull() | F.col("live_head").eqNullSafe(F.col("expected_head"))
    )
