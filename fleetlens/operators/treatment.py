"""Treatment comparison, replica routing and tenant enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARED_SCHEMA = "shared_schema_tenant_id"
TENANT_COLUMN = "tenant_id"


def compare_treatment(
    baseline: DataFrame, treatment: DataFrame, baseline_runs: DataFrame, treatment_runs: DataFrame
) -> DataFrame:
    """Baseline against treatment per (app, operation).

    Operations hold app_id, operation_id, query_count, duration_us; runs hold app_id,
    selected_tests, failed_tests.
    """
    key = ["app_id", "operation_id"]
    b = baseline.select(*key, F.struct("query_count", "duration_us").alias("b"))
    t = treatment.select(*key, F.struct("query_count", "duration_us").alias("t"))
    br = baseline_runs.select("app_id", F.struct("selected_tests", "failed_tests").alias("br"))
    tr = treatment_runs.select("app_id", F.struct("selected_tests", "failed_tests").alias("tr"))
    left, right = F.col("b"), F.col("t")
    reason = (
        F.when(left.isNull(), "operation absent from the baseline capture")
        .when(right.isNull(), "operation absent from the treatment capture")
        .when(F.col("br.failed_tests") > 0, "baseline itself had failing tests; nothing to preserve")
        .when(
            ~F.col("br.selected_tests").eqNullSafe(F.col("tr.selected_tests")),
            "baseline and treatment selected a different test set",
        )
    )
    zero = F.lit(0).cast("long")
    return (
        b.join(t, key, "full_outer")
        .join(br, "app_id", "left")
        .join(tr, "app_id", "left")
        .select(
            *key,
            F.coalesce(left["query_count"], zero).alias("baseline_query_count"),
            F.coalesce(right["query_count"], zero).alias("treatment_query_count"),
            left["duration_us"].alias("baseline_duration_us"),
            right["duration_us"].alias("treatment_duration_us"),
            (right["query_count"] < left["query_count"]).alias("amplification_reduced"),
            reason.alias("unsupported_reason"),
            (reason.isNull() & F.coalesce(F.col("tr.failed_tests") == 0, F.lit(True))).alias(
                "results_equivalent"
            ),
        )
        .withColumn(
            "verified",
            F.coalesce("amplification_reduced", F.lit(False)) & F.col("results_equivalent"),
        )
    )


def route_operations(operations: DataFrame, requirements: DataFrame) -> DataFrame:
    """Primary or replica verdict per operation, with its reason.

    Operations hold app_id, operation_id, tables_written, symbol; requirements hold app_id,
    operation_label, requires_read_after_write, lag_tolerance_seconds, ordinal. The first
    requirement of a label counts.
    """
    first = requirements.groupBy("app_id", F.col("operation_label").alias("symbol")).agg(
        F.min_by(
            F.struct("requires_read_after_write", "lag_tolerance_seconds"), "ordinal"
        ).alias("need")
    )
    need, lag = F.col("need"), F.col("need.lag_tolerance_seconds")
    writes = F.size("tables_written") > 0
    strict = need["requires_read_after_write"]
    no_lag = lag.isNull() | (lag == 0)
    return (
        operations.join(first, ["app_id", "symbol"], "left")
        .withColumn(
            "verdict",
            F.when(writes, "primary_required")
            .when(need.isNull(), "unknown_blocked")
            .when(~strict, "replica_eligible")
            .when(no_lag, "primary_required")
            .otherwise("either"),
        )
        .withColumn(
            "reason",
            F.when(writes, "writes at least one table; a write must reach the primary")
            .when(need.isNull(), "no confirmed read-after-write requirement for this operation")
            .when(~strict, "confirmed read-only with no read-after-write requirement")
            .when(no_lag, "confirmed to require immediate read-after-write consistency")
            .otherwise(F.format_string("confirmed to tolerate %ds of replica lag", lag)),
        )
        .drop("need")
    )


def tenant_enforcement_gaps(
    queries: DataFrame, columns: DataFrame, predicates: DataFrame, context: DataFrame
) -> DataFrame:
    """(app_id, table_id, query_id, reason): tenant tables used with no predicate on the tenant.

    Only applications confirmed to share one schema between tenants are looked at.
    """
    shared = context.where(F.col("tenant_model") == SHARED_SCHEMA).select("app_id")
    used = (
        queries.where("statement_class IN ('read', 'write')")
        .join(shared, "app_id", "left_semi")
        .select("app_id", "query_id", F.explode("relations").alias("table_id"))
        .distinct()
    )
    scoped = columns.where(F.col("name") == TENANT_COLUMN).select("app_id", "table_id").distinct()
    guarded = predicates.where(
        F.col("column_id") == F.concat("table_id", F.lit(f".{TENANT_COLUMN}"))
    ).select("app_id", "query_id", "table_id")
    return (
        used.join(scoped, ["app_id", "table_id"], "left_semi")
        .join(guarded, ["app_id", "query_id", "table_id"], "left_anti")
        .withColumn(
            "reason",
            F.concat(
                "table_id",
                F.lit(
                    " is tenant-scoped, but no recognized predicate on "
                    f"{TENANT_COLUMN} was found in this query"
                ),
            ),
        )
    )
