"""Rules over reconciled catalogs, and the findings they produce.

Findings: app_id, id, rule, rule_version, title, priority, category, statement,
affected_objects, evidence_refs, change_kind, change_summary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.identity import RULE_ID_PATTERN, identity_part
from fleetlens.operators.reconcile import evidence_id, reconcile_relationships
from fleetlens.plans.ordering import running_total

UNINDEXED = "workload.unindexed_foreign_key"
NOT_ENFORCED = "schema.orm_relationship_without_physical_fk"
CONFIRM_MODEL = "tenancy.confirm_isolation_model"
TENANT_COLUMN = "tenant_id"
TENANT_TABLES = ["tenant", "tenants"]
# Priorities from most to least severe.
SEVERITY = {
    "required_for_correctness": 0,
    "required_by_confirmed_requirements": 1,
    "verified_improvement": 2,
    "worth_evaluating": 3,
    "optional_hardening": 4,
}
REQUIRED = ["required_for_correctness", "required_by_confirmed_requirements"]
INCOMPLETE_INDEXES = (
    "index-candidate analysis skipped: an index operation in the migration history was not "
    "statically resolvable, so absence of a covering index cannot be confirmed"
)
FINDING_COLUMNS = [
    "app_id",
    "id",
    "rule",
    "rule_version",
    "title",
    "priority",
    "category",
    "statement",
    "affected_objects",
    "evidence_refs",
    "change_kind",
    "change_summary",
]


@dataclass(frozen=True)
class RuleOutput:
    """What one rule reports; a missing part means the rule has none."""

    findings: DataFrame | None = None
    questions: DataFrame | None = None
    reasons: DataFrame | None = None


Context = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    id: str
    version: int
    evaluate: Callable[[Context], RuleOutput]


def _finding(identity: Column, rule: str, **fields: Column | str) -> list[Column]:
    values = {k: F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    values |= {"id": identity, "rule": F.lit(rule), "rule_version": F.lit(1)}
    return [F.col("app_id"), *[values[name].alias(name) for name in FINDING_COLUMNS[1:]]]


def covered_columns(constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """(app_id, column_id) that lead any index, primary key or unique constraint."""
    leading = indexes.select("app_id", F.get("keys", F.lit(0))["column"].alias("column_id"))
    keyed = constraints.where("kind IN ('primary_key', 'unique')").select(
        "app_id", F.get("columns", F.lit(0)).alias("column_id")
    )
    return leading.unionByName(keyed).where("column_id IS NOT NULL").distinct()


def unindexed_foreign_keys(ctx: Context) -> RuleOutput:
    """Single-column foreign keys nothing leads with; silent for an app with unseen indexes."""
    constraints = ctx["constraints"]
    blind = (
        ctx["unsupported"].where(F.col("reason").contains("create_index")).select("app_id").distinct()
    )
    open_keys = (
        constraints.where("kind = 'foreign_key' AND size(columns) = 1")
        .withColumn("column_id", F.get("columns", F.lit(0)))
        .join(covered_columns(constraints, ctx["indexes"]), ["app_id", "column_id"], "left_anti")
        .join(blind, "app_id", "left_anti")
        .select("app_id", "column_id", "ordinal", "name")
    )
    numbered = running_total(open_keys, ["app_id"], ["column_id", "ordinal", "name"], "number")
    place = F.concat(identity_part("column_id", 2), F.lit("."), identity_part("column_id", 3))
    findings = numbered.select(
        *_finding(
            F.format_string("IDX-%03d", F.col("number").cast("long")),
            UNINDEXED,
            title=F.concat(F.lit("Index "), place),
            priority="worth_evaluating",
            category="query",
            statement=F.concat(
                place,
                F.lit(
                    " is a foreign key with no covering index; "
                    "lookups and cascading operations on it scan the table."
                ),
            ),
            affected_objects=F.array("column_id"),
            evidence_refs=F.array().cast("array<string>"),
            change_kind="add_index",
            change_summary=F.concat(F.lit("Add a btree index on "), place, F.lit(".")),
        )
    )
    reasons = blind.select("app_id", F.lit(INCOMPLETE_INDEXES).alias("reason"))
    return RuleOutput(findings=findings, reasons=reasons)


def undeclared_physical_keys(ctx: Context) -> RuleOutput:
    """Declared relationships without a foreign key, as TENANT-nnn or SCHEMA-nnn."""
    observed = reconcile_relationships(ctx["constraints"], ctx["relationships"]).where(
        "kind = 'orm_only_relationship'"
    )
    model = F.coalesce("tenant_model", F.lit("unknown"))
    source = identity_part(F.get("objects", F.lit(0)), 2)
    target = identity_part(F.get("objects", F.lit(1)), 2)
    by_name = F.lower(target).isin(TENANT_TABLES)
    tenant = F.when(model == "unknown", by_name).otherwise(model != "single_tenant")
    prefixed = (
        observed.join(ctx["context"].select("app_id", "tenant_model"), "app_id", "left")
        .withColumn("prefix", F.when(tenant, "TENANT").otherwise("SCHEMA"))
        .withColumn("source", F.get("objects", F.lit(0)))
        .withColumn("target", F.get("objects", F.lit(1)))
        .drop("tenant_model")
    )
    numbered = running_total(prefixed, ["app_id", "prefix"], ["ordinal", "source", "target"], "number")
    findings = numbered.select(
        *_finding(
            F.format_string("%s-%03d", "prefix", F.col("number").cast("long")),
            NOT_ENFORCED,
            title=F.concat(
                F.lit("Enforce the "), source, F.lit(" to "), target, F.lit(" relationship physically")
            ),
            priority="required_for_correctness",
            category=F.when(F.col("prefix") == "TENANT", "tenancy").otherwise("schema"),
            statement=F.col("summary"),
            affected_objects=F.col("objects"),
            evidence_refs=F.array(evidence_id(F.col("kind"), F.col("objects"))),
            change_kind="add_constraint",
            change_summary=F.concat(
                F.lit("Add a physical foreign key from "), source, F.lit(" to "), target, F.lit(".")
            ),
        )
    )
    return RuleOutput(findings=findings)


def tenant_model_question(ctx: Context) -> RuleOutput:
    """One question per app with a tenant-shaped column and no confirmed model."""
    shaped = (
        ctx["columns"]
        .select("app_id", "name")
        .unionByName(ctx["declared_columns"].select("app_id", "name"))
        .where(F.col("name") == TENANT_COLUMN)
        .select("app_id")
        .distinct()
    )
    confirmed = ctx["context"].where("coalesce(tenant_model, 'unknown') <> 'unknown'").select("app_id")
    questions = shaped.join(confirmed, "app_id", "left_anti").select(
        "app_id", F.lit("core_tenant_model").alias("question"), F.lit(CONFIRM_MODEL).alias("rule")
    )
    return RuleOutput(questions=questions)


RULES: list[Rule] = [
    Rule(NOT_ENFORCED, 1, undeclared_physical_keys),
    Rule(UNINDEXED, 1, unindexed_foreign_keys),
    Rule(CONFIRM_MODEL, 1, tenant_model_question),
]


def register_rule(rule_id: str, version: int, evaluate: Callable[[Context], RuleOutput]) -> None:
    """Add a rule. The version moves when the rule's logic changes."""
    if any(rule.id == rule_id for rule in RULES):
        raise ValueError(f"rule {rule_id} is registered already")
    RULES.append(Rule(rule_id, version, evaluate))


def run_rules(ctx: Context, rules: list[Rule] | None = None) -> RuleOutput:
    """Every rule's output, folded into one."""
    outputs = [rule.evaluate(ctx) for rule in (RULES if rules is None else rules)]

    def fold(part: str) -> DataFrame | None:
        frames = [getattr(o, part) for o in outputs if getattr(o, part) is not None]
        return reduce(DataFrame.unionByName, frames) if frames else None

    return RuleOutput(fold("findings"), fold("questions"), fold("reasons"))


def severity(priority: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.try_element_at(table, F.col(priority) if isinstance(priority, str) else priority)


def headline_findings(findings: DataFrame, shown: int = 3) -> DataFrame:
    """First `shown` findings per app by severity and id, with the number left unshown.

    The rank filter is pushed below the shuffle, so each task sends at most `shown` rows per app.
    """
    headline = findings.where("priority <> 'optional_hardening'").withColumn(
        "severity", severity("priority")
    )
    order = Window.partitionBy("app_id").orderBy("severity", "id")
    top = headline.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)
    counts = headline.groupBy("app_id").agg(
        F.greatest(F.count("*") - shown, F.lit(0)).alias("hidden")
    )
    return top.join(counts, "app_id")


def finding_counts(findings: DataFrame, questions: DataFrame) -> DataFrame:
    """Required, worth evaluating and questions per app, and for the fleet (app_id null)."""
    facts = findings.select("app_id", F.col("priority").alias("what")).unionByName(
        questions.select("app_id", F.lit("question").alias("what"))
    )
    return facts.rollup("app_id").agg(
        F.count_if(F.col("what").isin(REQUIRED)).alias("required"),
        F.count_if(F.col("what") == "worth_evaluating").alias("worth_evaluating"),
        F.count_if(F.col("what") == "question").alias("questions"),
    )


def finding_sources(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(app_id, id, sources): `path:line` of each cited evidence, in citation order.

    The list is as long as one finding's citations.
    """
    located = evidence.where("path IS NOT NULL").select(
        "app_id",
        F.col("evidence_id").alias("ref"),
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("place"),
    )
    cited = findings.select("app_id", "id", F.posexplode("evidence_refs").alias("at", "ref"))
    return (
        cited.join(located, ["app_id", "ref"])
        .groupBy("app_id", "id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "place")))["place"].alias("sources"))
    )


def finding_validity(findings: DataFrame) -> DataFrame:
    """(app_id, id, problem) for findings that contradict themselves."""
    verified = F.col("verification_state") == "verified_in_fixture"
    measured = F.col("measurement").isNotNull()
    problems = F.array(
        F.when(
            F.size(F.coalesce("affected_objects", F.array())) == 0,
            "a recommendation must name at least one affected object",
        ),
        F.when(
            F.col("change_kind").isNull() & F.col("blocking_question").isNull(),
            "a recommendation must carry a proposed change or a blocking question",
        ),
        F.when(verified & ~measured, "verified_in_fixture requires a fixture measurement to cite"),
        F.when(measured & ~verified, "a fixture measurement may only accompany verified_in_fixture"),
        F.when(
            (F.col("priority") == "verified_improvement") & ~verified,
            "verified_improvement requires verification_state verified_in_fixture",
        ),
        F.when(~F.col("rule").rlike(RULE_ID_PATTERN), "not a rule id"),
    )
    return findings.select(
        "app_id", "id", F.explode(F.array_compact(problems)).alias("problem")
    )
