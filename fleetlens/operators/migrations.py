"""Migration histories of a fleet: revision graphs, risks and staged plans.

`revisions` holds (app_id, revision, parents array<string>); `operations` holds app_id, pos (a
whole number, unique inside the app, in replay order), revision, kind, table_name, object_name,
new_name, columns, ref_table, ref_columns, nullable, new_type, primary_key, concurrently,
has_nullable, has_default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.identity import frame_components
from fleetlens.plans.graphs import cycle_members, peel
from fleetlens.plans.ordering import running_total

APP = ["app_id"]

# Risk reasons and assumptions.
LOCK_ASSUMPTION = (
    "assumes PostgreSQL 11+: a constant DEFAULT on a new column is metadata-only; "
    "an added NOT NULL column with no default, or a volatile default, still requires "
    "a full table scan to validate or populate existing rows"
)
TYPE_ASSUMPTION = (
    "ALTER COLUMN TYPE rewrites the table unless the old and new types are binary "
    "coercible, which this analysis cannot verify statically"
)
NEW_CONSTRAINTS = ["create_unique_constraint", "create_foreign_key", "create_check_constraint"]


# --- revision graph --------------------------------------------------------------------------


def parent_edges(revisions: DataFrame) -> DataFrame:
    """(app_id, child, parent) for every declared parent, known or not."""
    return revisions.select(
        "app_id", F.col("revision").alias("child"), F.explode("parents").alias("parent")
    )


def known_edges(revisions: DataFrame) -> DataFrame:
    known = revisions.select("app_id", F.col("revision").alias("parent"))
    return parent_edges(revisions).join(known, ["app_id", "parent"], "left_semi")


def revision_graph(revisions: DataFrame) -> DataFrame:
    """(app_id, role, revision): roots, heads, merges and missing parents."""
    edges = parent_edges(revisions)
    ids = revisions.select("app_id", "revision")
    as_parent = edges.select("app_id", F.col("parent").alias("revision"))

    def role(name: str, frame: DataFrame) -> DataFrame:
        return frame.select("app_id", F.lit(name).alias("role"), "revision")

    return (
        role("root", revisions.where(F.size("parents") == 0))
        .unionByName(role("head", ids.join(as_parent, ["app_id", "revision"], "left_anti")))
        .unionByName(role("merge", revisions.where(F.size("parents") > 1)))
        .unionByName(
            role("missing", as_parent.join(ids, ["app_id", "revision"], "left_anti").distinct())
        )
    )


def revision_cycles(revisions: DataFrame) -> DataFrame:
    """(app_id, node, component): all members of all cycles."""
    return cycle_members(known_edges(revisions), APP)


def replay_obstacles(revisions: DataFrame, stuck: DataFrame | None = None) -> DataFrame:
    """(app_id, reason) for apps whose history cannot be ordered, first obstacle first.

    `stuck` are the edges on or behind a cycle, when the caller has them already.
    """
    graph = revision_graph(revisions)
    facts = graph.groupBy("app_id").agg(
        F.count_if(F.col("role") == "head").alias("heads"),
        F.count_if(F.col("role") == "missing").alias("missing"),
    )
    if stuck is None:
        _levels, stuck = peel(known_edges(revisions), APP)
    cyclic = stuck.select("app_id").distinct().withColumn("cyclic", F.lit(True))
    note = (
        F.when(F.col("cyclic"), "a revision cycle")
        .when(F.col("missing") > 0, "a missing predecessor")
        .when(F.col("heads") != 1, F.format_string("%d heads", "heads"))
    )
    return (
        facts.join(cyclic, "app_id", "left")
        .withColumn("note", note)
        .where("note IS NOT NULL")
        .select(
            "app_id",
            F.concat(F.lit("schema not replayed: the revision graph has "), "note").alias("reason"),
        )
    )


def revision_order(revisions: DataFrame) -> DataFrame:
    """(app_id, revision, level, position): parents first, only for apps without an obstacle."""
    levels, stuck = peel(known_edges(revisions), APP)
    clear = revisions.select("app_id", "revision").join(
        replay_obstacles(revisions, stuck), "app_id", "left_anti"
    )
    placed = clear.join(
        levels.withColumnRenamed("node", "revision"), ["app_id", "revision"], "left"
    ).withColumn("level", F.coalesce("level", F.lit(0)))
    return running_total(placed, APP, ["level", "revision"], "position")


def added_revisions(base: DataFrame, current: DataFrame) -> DataFrame:
    """Revisions of the current branch that the base lacks."""
    return current.join(base.select("app_id", "revision"), ["app_id", "revision"], "left_anti")


def select_physical_schema(environments: DataFrame) -> DataFrame:
    """First environment with a resolved head per app; apps without one keep nulls."""
    chosen = environments.groupBy("app_id").agg(
        F.expr(
            "min_by(struct(environment, head), ord) FILTER (WHERE head IS NOT NULL)"
        ).alias("chosen")
    )
    return chosen.select("app_id", "chosen.environment", "chosen.head")


# --- risks and plans -------------------------------------------------------------------------


def migration_risks(operations: DataFrame) -> DataFrame:
    """(app_id, revision, pos, operation, category, reason, reversible, assumption, change_kind).

    A table created in the same revision holds no rows yet, so only dropping it is a risk.
    """
    created = (
        operations.where("kind = 'create_table'")
        .select("app_id", "revision", "table_name")
        .distinct()
        .withColumn("fresh", F.lit(True))
    )
    kind = F.col("kind")
    not_null = F.col("has_nullable") & ~F.coalesce("nullable", F.lit(False)) & ~F.col("has_default")

    def risk(category: str, reason: str, reversible: bool, assumption: str | None = None, change: str | None = None) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            F.lit(reason).alias("reason"),
            F.lit(reversible).alias("reversible"),
            F.lit(assumption).cast("string").alias("assumption"),
            F.lit(change).cast("string").alias("change_kind"),
        )

    found = (
        F.when(
            kind == "drop_table",
            risk("destructive", "drops a table and every row it holds; there is no automatic undo", False),
        )
        .when(F.col("fresh"), None)
        .when(
            kind == "drop_column",
            risk("destructive", "drops a column and every value it holds; there is no automatic undo", False),
        )
        .when(
            kind == "drop_constraint",
            risk("constraint", "removes a constraint; re-adding it later re-validates every existing row", True),
        )
        .when(
            kind.isin(NEW_CONSTRAINTS),
            risk(
                "constraint",
                "a new constraint, added directly, validates every existing row while held",
                True,
                change="add_constraint",
            ),
        )
        .when(
            (kind == "add_column") & not_null,
            risk(
                "constraint",
                "a NOT NULL column with no default requires a full table scan "
                "to populate existing rows before the constraint can be enforced",
                True,
                LOCK_ASSUMPTION,
            ),
        )
        .when(
            (kind == "alter_column") & F.col("new_type").isNotNull(),
            risk("type_change", "changes a column's declared type", False, TYPE_ASSUMPTION, "alter_column"),
        )
        .when(
            (kind == "create_index") & ~F.coalesce("concurrently", F.lit(False)),
            risk(
                "index",
                "an ordinary CREATE INDEX holds a lock that blocks writes to this "
                "table for the duration of the build; CREATE INDEX CONCURRENTLY does not",
                True,
                change="add_index",
            ),
        )
    )
    return (
        operations.join(created, ["app_id", "revision", "table_name"], "left")
        .withColumn("risk", found)
        .where("risk IS NOT NULL")
        .select("app_id", "revision", "pos", F.col("kind").alias("operation"), "risk.*")
    )


# Step texts by change kind; null text means the change's own summary or note.
_STEPS = {
    "add_constraint": [
        (
            "{summary} Add it NOT VALID so existing rows are not checked immediately.",
            None,
            "Safe without a maintenance window: NOT VALID acquires only a brief metadata lock.",
            "Drop the NOT VALID constraint; no data was altered.",
            "Confirm the constraint exists and is marked NOT VALID.",
        ),
        (
            "Run VALIDATE CONSTRAINT to check existing rows without blocking concurrent writes.",
            "Existing rows are validated in place; a violating row must be corrected first.",
            "Run once existing data is known to satisfy the constraint.",
            "A failed validation leaves the constraint NOT VALID; nothing to undo.",
            "Confirm the constraint is no longer marked NOT VALID.",
        ),
    ],
    "add_index": [
        (
            "{summary} Create it CONCURRENTLY to avoid locking writes.",
            None,
            "Safe against a live table: CONCURRENTLY builds without an exclusive lock.",
            "Drop the index; no data was altered.",
            "Confirm the index exists and is not marked INVALID.",
        )
    ],
    None: [
        (
            "{summary}",
            None,
            "Not yet staged; review before deploying.",
            None,
            "Confirm the change was applied as sketched.",
        )
    ],
}


def expand_plan_steps(findings: DataFrame, scenario: str) -> DataFrame:
    """Ordered plan steps of each finding's change; none for a finding without a change.

    `findings` holds app_id, id, change_kind, change_summary, rollback_note.
    """

    def step(position: int, texts: tuple[str | None, ...]) -> Column:
        action, validation, boundary, rollback, verification = texts
        assert action is not None
        before, _mark, after = action.partition("{summary}")
        whole = action if not _mark else None
        missing = F.lit("No rollback sketch is available for this change.")
        return F.struct(
            frame_components(F.col("id"), F.lit(position)).alias("step_id"),
            (
                F.array(frame_components(F.col("id"), F.lit(position - 1)))
                if position
                else F.array().cast("array<string>")
            ).alias("dependency_ids"),
            (
                F.lit(whole)
                if whole
                else F.concat(F.lit(before), F.col("change_summary"), F.lit(after))
            ).alias("schema_action"),
            F.lit(validation).cast("string").alias("backfill_or_validation"),
            F.lit(boundary).alias("deployment_boundary"),
            (F.lit(rollback) if rollback else F.coalesce("rollback_note", missing)).alias("rollback_note"),
            F.lit(verification).alias("verification_requirement"),
        )

    steps = None
    for kind in ("add_constraint", "add_index"):
        listed = F.array(*[step(i, texts) for i, texts in enumerate(_STEPS[kind])])
        matches = F.col("change_kind") == kind
        steps = F.when(matches, listed) if steps is None else steps.when(matches, listed)
    steps = steps.otherwise(F.array(*[step(i, texts) for i, texts in enumerate(_STEPS[None])]))
    return findings.where("change_kind IS NOT NULL").select(
        "app_id", F.col("id").alias("recommendation"), F.lit(scenario).alias("scenario"), F.inline(steps)
    )


def plan_order(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, cyclic): (app_id, step_id, level, position), and the steps no order exists for.

    Steps are taken level by level, ties by id: every dependency comes first.
    """
    ids = steps.select("app_id", "step_id").distinct()
    edges = steps.select(
        "app_id", F.col("step_id").alias("child"), F.explode("dependency_ids").alias("parent")
    )
    levels, stuck = peel(edges, APP)
    cyclic = stuck.select("app_id", F.col("child").alias("step_id")).distinct()
    placed = (
        ids.join(cyclic.select("app_id").distinct(), "app_id", "left_anti")
        .join(levels.withColumnRenamed("node", "step_id"), ["app_id", "step_id"], "left")
        .withColumn("level", F.coalesce("level", F.lit(0)))
    )
    return running_total(placed, APP, ["level", "step_id"], "position"), cyclic


def plan_integrity(steps: DataFrame) -> DataFrame:
    """(app_id, problem, step_id): repeated step ids and dependencies on unknown steps."""
    repeated = (
        steps.groupBy("app_id", "step_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("app_id", F.lit("plan step ids must be unique").alias("problem"), "step_id")
    )
    wanted = steps.select("app_id", F.explode("dependency_ids").alias("step_id")).distinct()
    unknown = wanted.join(steps.select("app_id", "step_id"), ["app_id", "step_id"], "left_anti").select(
        "app_id", F.lit("plan steps depend on unknown step ids").alias("problem"), "step_id"
    )
    return repeated.unionByName(unknown)
