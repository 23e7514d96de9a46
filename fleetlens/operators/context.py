"""Interview answers, scenarios and decisions, folded from append logs.

Every fold is one aggregation by (app, question) or (app, recommendation) with the position as
the order, so it combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.identity import (
    DECIMAL_PATTERN,
    canonical_hash,
    split_list,
    split_two,
)

# The core interview in asking order, tenant models, scenario contents.
CORE_QUESTIONS = [
    "core_critical_operations",
    "core_table_scale",
    "core_read_write_mix",
    "core_tenant_model",
    "core_read_after_write",
    "core_rpo_rto",
    "core_retention",
]
TENANT_MODELS = [
    "single_tenant",
    "shared_schema_tenant_id",
    "schema_per_tenant",
    "database_per_tenant",
    "unknown",
]
SCENARIOS = {
    "launch_minimal": (
        "Launch-minimal",
        "The simplest design satisfying confirmed launch scale.",
        [],
    ),
    "growth_ready": (
        "Growth-ready",
        "The design needed for the confirmed 12-month scale and its critical paths.",
        ["core_table_scale"],
    ),
    "availability_ready": (
        "Availability-ready",
        "Adds the confirmed recovery targets and consistency requirements.",
        ["core_rpo_rto", "core_read_after_write"],
    ),
}


def fold_answers(answers: DataFrame) -> DataFrame:
    """Latest (state, value) per (app_id, question), with its position as the new order."""
    return (
        answers.groupBy("app_id", "question")
        .agg(F.max_by(F.struct("state", "value"), "pos").alias("last"), F.max("pos").alias("pos"))
        .select("app_id", "question", "last.state", "last.value", "pos")
    )


def derive_context(answers: DataFrame) -> DataFrame:
    """One row per app with the fields its answered questions resolve.

    A later unknown answer does not take back a field an earlier answer gave, and a part that
    cannot be read (a peak that is no number, an unknown tenant model) leaves the field alone.
    """
    given = "state = 'answered' AND value IS NOT NULL"
    pair = split_two("value")
    facts = (
        answers.withColumn("_first", F.when(F.expr(given), pair["first"]))
        .withColumn("_second", F.when(F.expr(given), pair["second"]))
        .withColumn("_models", F.array(*[F.lit(m) for m in TENANT_MODELS]))
    )

    def last(field: str, question: str, more: str = "true") -> Column:
        return F.expr(
            f"max_by({field}, pos) FILTER (WHERE {given} AND question = '{question}' AND {more})"
        )

    folded = facts.groupBy("app_id").agg(
        last("value", "core_critical_operations").alias("critical"),
        last("_first", "core_read_write_mix").alias("read_write_ratio"),
        last("_second", "core_read_write_mix", "_second rlike '^[0-9]+$'").alias("peak"),
        last("value", "core_tenant_model", "array_contains(_models, value)").alias("tenant_model"),
        last("value", "core_read_after_write").alias("flows"),
        last("_first", "core_rpo_rto").alias("rpo"),
        last("_second", "core_rpo_rto", "_second IS NOT NULL").alias("rto"),
        last("value", "core_retention").alias("retention"),
    )
    empty = F.array().cast("array<string>")
    return folded.select(
        "app_id",
        F.coalesce(split_list("critical"), empty).alias("critical_operations"),
        "read_write_ratio",
        F.col("peak").cast("long").alias("peak_requests_per_second"),
        F.coalesce("tenant_model", F.lit("unknown")).alias("tenant_model"),
        F.coalesce(split_list("flows"), empty).alias("read_after_write_flows"),
        "rpo",
        "rto",
        F.coalesce(split_list("retention"), empty).alias("retention_constraints"),
    )


def applicable_questions(apps: DataFrame, columns: DataFrame) -> DataFrame:
    """(app_id, ord, question): the core interview, the tenant question only where it applies."""
    shaped = columns.where("name = 'tenant_id'").select("app_id").distinct().withColumn(
        "shaped", F.lit(True)
    )
    listed = apps.join(shaped, "app_id", "left").select(
        "app_id",
        "shaped",
        F.posexplode(F.array(*[F.lit(q) for q in CORE_QUESTIONS])).alias("ord", "question"),
    )
    return listed.where("shaped OR question <> 'core_tenant_model'").drop("shaped")


def remaining_questions(applicable: DataFrame, answers: DataFrame) -> DataFrame:
    """Applicable questions with no recorded answer in any state."""
    asked = answers.select("app_id", "question").distinct()
    return applicable.join(asked, ["app_id", "question"], "left_anti")


def next_question(remaining: DataFrame) -> DataFrame:
    return remaining.groupBy("app_id").agg(F.min_by("question", "ord").alias("next_question"))


def table_scale_growth(scales: DataFrame) -> DataFrame:
    """Present and 12-month rows as exact decimals, with their ratio."""

    def number(name: str) -> Column:
        return F.when(F.col(name).rlike(DECIMAL_PATTERN), F.col(name).try_cast("decimal(38,6)"))

    return scales.select(
        "app_id",
        "table_id",
        number("current_rows").alias("current_rows"),
        number("rows_in_twelve_months").alias("rows_in_twelve_months"),
    ).withColumn(
        "growth",
        F.try_divide(
            F.col("rows_in_twelve_months").cast("double"), F.col("current_rows").cast("double")
        ),
    )


def _scenario_rows() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(kind).alias("scenario"),
                F.lit(title).alias("title"),
                F.lit(summary).alias("summary"),
                (
                    F.array(*[F.lit(q) for q in required])
                    if required
                    else F.array().cast("array<string>")
                ).alias("required"),
            )
            for kind, (title, summary, required) in SCENARIOS.items()
        ]
    )


def scenario_blockers(apps: DataFrame, answers: DataFrame) -> DataFrame:
    """(app_id, scenario, ord, question): required questions not answered yet."""
    answered = fold_answers(answers).where("state = 'answered'").select("app_id", "question")
    wanted = (
        apps.select("app_id", F.inline(_scenario_rows()))
        .select("app_id", "scenario", F.posexplode("required").alias("ord", "question"))
    )
    return wanted.join(answered, ["app_id", "question"], "left_anti")


def build_scenarios(apps: DataFrame, findings: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per (app, scenario): titles, number of recommendations, open blockers."""
    counts = findings.groupBy("app_id").agg(F.count("*").alias("recommendations"))
    blockers = (
        scenario_blockers(apps, answers)
        .groupBy("app_id", "scenario")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "question")))["question"].alias("open"))
    )
    return (
        apps.select("app_id", F.inline(_scenario_rows()))
        .drop("required")
        .join(counts, "app_id", "left")
        .join(blockers, ["app_id", "scenario"], "left")
        .select(
            "app_id",
            "scenario",
            "title",
            "summary",
            F.coalesce("recommendations", F.lit(0).cast("long")).alias("recommendations"),
            F.coalesce("open", F.array().cast("array<string>")).alias("unresolved_blockers"),
        )
    )


def scenario_recommendations(findings: DataFrame) -> DataFrame:
    """(app_id, scenario, recommendation): every scenario carries every finding."""
    kinds = F.array(*[F.lit(kind) for kind in SCENARIOS])
    return findings.select(
        "app_id", F.explode(kinds).alias("scenario"), F.col("id").alias("recommendation")
    )


def diff_recommendations(base: DataFrame, target: DataFrame) -> DataFrame:
    """(app_id, kind, recommendation, explanation): added, removed, changed in any field."""
    key = ["app_id", "id"]
    fields = sorted(c for c in base.columns if c not in key)
    b = base.select(*key, F.struct(*fields).alias("b"))
    t = target.select(*key, F.struct(*fields).alias("t"))
    kind = (
        F.when(F.col("b").isNull(), "added")
        .when(F.col("t").isNull(), "removed")
        .when(~F.col("b").eqNullSafe(F.col("t")), "changed")
    )
    text = (
        F.when(F.col("kind") == "added", " is newly reported.")
        .when(F.col("kind") == "removed", " is no longer reported.")
        .otherwise(" is reported differently.")
    )
    return (
        b.join(t, key, "full_outer")
        .select("app_id", kind.alias("kind"), F.col("id").alias("recommendation"))
        .where("kind IS NOT NULL")
        .withColumn("explanation", F.concat("recommendation", text))
    )


def sole_changed_answer(base: DataFrame, target: DataFrame) -> DataFrame:
    """(app_id, caused_by): the one question whose answer differs, null when several do.

    Both sides are folded answers; apps without a change are not listed.
    """
    key = ["app_id", "question"]
    b = base.select(*key, F.struct("state", "value").alias("b"))
    t = target.select(*key, F.struct("state", "value").alias("t"))
    changed = b.join(t, key, "full_outer").where(~F.col("b").eqNullSafe(F.col("t")))
    return changed.groupBy("app_id").agg(
        F.when(F.count("*") == 1, F.min("question")).alias("caused_by")
    )


def context_hash(context: DataFrame) -> DataFrame:
    """(app_id, context_hash) over the derived context row."""
    fields = [c for c in context.columns if c != "app_id"]
    return context.select("app_id", canonical_hash(*fields).alias("context_hash"))


# --- decisions -------------------------------------------------------------------------------


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each (app_id, recommendation)."""
    rest = [c for c in decisions.columns if c not in ("app_id", "recommendation")]
    return (
        decisions.groupBy("app_id", "recommendation")
        .agg(F.max_by(F.struct(*rest), "pos").alias("last"))
        .select("app_id", "recommendation", "last.*")
    )


def reactivated_decisions(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """Latest rejected or deferred decisions whose evidence hash has moved since.

    `current` holds app_id and current_hash.
    """
    return (
        latest_decisions(decisions)
        .where("kind <> 'accepted'")
        .join(current, "app_id")
        .where("input_manifest_hash <> current_hash")
    )


def changed_decisions(base: DataFrame, head: DataFrame) -> DataFrame:
    """Decisions of the head that the base lacks, by recommendation, kind and moment."""
    identity = ["app_id", "recommendation", "kind", "decided_at"]
    return head.join(base.select(*identity).distinct(), identity, "left_anti")


def decision_validity(
    requests: DataFrame, recommendations: DataFrame, current: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(accepted, unknown): decisions on known recommendations, stamped with the current hash."""
    known = recommendations.select("app_id", F.col("id").alias("recommendation")).distinct()
    on = ["app_id", "recommendation"]
    accepted = (
        requests.drop("input_manifest_hash")
        .join(known, on, "left_semi")
        .join(current.withColumnRenamed("current_hash", "input_manifest_hash"), "app_id")
    )
    return accepted, requests.join(known, on, "left_anti")
