"""Statistics, verdicts and evidence checks of control / treatment / drift experiments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the measurement protocol.
WARMUPS = 3
SAMPLES = 7
ARMS = ["control_a1", "treatment_b", "drift_control_a2"]
VARIANCE_THRESHOLD = 0.25
DRIFT_TOLERANCE = 0.10
MIN_VERIFIED_RATIO = 1.2

RUN = ["case_id", "run"]


def arm_statistics(
    samples: DataFrame, variance_threshold: float = VARIANCE_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """(statistics, problems) per (case, run, arm).

    Median and quartiles are fixed positions of exactly seven sorted samples; an arm with any
    other number of samples is a problem row. At most eight rows per arm are listed: the rank
    filter is pushed below the shuffle.
    """
    timed = samples.where("kind = 'sample'")
    order = Window.partitionBy(*RUN, "arm").orderBy("value_us", "idx")
    few = timed.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= SAMPLES + 1)
    listed = few.groupBy(*RUN, "arm").agg(
        F.array_sort(F.collect_list("value_us")).alias("sorted"), F.max("rows").alias("row_count")
    )

    def at(position: int) -> Column:
        return F.element_at("sorted", position).cast("double")

    full = listed.where(F.size("sorted") == SAMPLES).select(
        *RUN,
        "arm",
        "row_count",
        at(4).alias("median_us"),
        at(1).alias("min_us"),
        at(7).alias("max_us"),
        at(2).alias("q1_us"),
        at(6).alias("q3_us"),
        (F.aggregate("sorted", F.lit(0).cast("long"), lambda a, v: a + v) / SAMPLES).alias("mean_us"),
    )
    statistics = full.withColumn(
        "iqr_fraction", F.try_divide(F.col("q3_us") - F.col("q1_us"), F.col("median_us"))
    ).withColumn("high_variance", F.col("iqr_fraction") > variance_threshold)
    counts = timed.groupBy(*RUN, "arm").agg(F.count("*").alias("n"))
    problems = counts.where(F.col("n") != SAMPLES).select(
        *RUN, "arm", F.format_string(f"expected {SAMPLES} samples, got %d", "n").alias("problem")
    )
    return statistics, problems


def compare_arms(statistics: DataFrame) -> DataFrame:
    """Saving, ratio and drift per (case, run); null where an arm is missing."""
    medians = statistics.groupBy(*RUN).pivot("arm", ARMS).agg(F.max("median_us"))
    a1, b, a2 = (F.col(name) for name in ARMS)
    return medians.select(
        *RUN,
        (a1 - b).alias("absolute_saving_us"),
        F.try_divide(a1, b).alias("ratio"),
        F.try_divide(F.abs(a2 - a1), a1).alias("drift_fraction"),
        (a1.isNotNull() & b.isNotNull() & a2.isNotNull()).alias("complete"),
    )


def experiment_verdict(
    statistics: DataFrame, drift_tolerance: float = DRIFT_TOLERANCE
) -> DataFrame:
    """Quantities and the inconclusive flag per (case, run), from one aggregation."""
    medians = {
        name: F.max(F.when(F.col("arm") == name, F.col("median_us"))).alias(f"_{name}")
        for name in ARMS
    }
    grouped = statistics.groupBy(*RUN).agg(
        *medians.values(), F.bool_or("high_variance").alias("high_variance")
    )
    a1, b, a2 = (F.col(f"_{name}") for name in ARMS)
    complete = a1.isNotNull() & b.isNotNull() & a2.isNotNull()
    drift = F.when(complete, F.try_divide(F.abs(a2 - a1), a1))
    return (
        grouped.withColumn("complete", complete)
        .withColumn("absolute_saving_us", F.when(complete, a1 - b))
        .withColumn("ratio", F.when(complete, F.try_divide(a1, b)))
        .withColumn("drift_fraction", drift)
        .withColumn("drift_detected", F.coalesce(drift > drift_tolerance, F.lit(False)))
        .withColumn(
            "inconclusive", ~F.col("complete") | F.col("high_variance") | F.col("drift_detected")
        )
        .drop(*[f"_{name}" for name in ARMS])
    )


def case_summary(statistics: DataFrame) -> DataFrame:
    """Ranges of ratio and saving, largest control noise and drift, per case."""
    compared = compare_arms(statistics)
    control = statistics.where(F.col("arm") == ARMS[0]).groupBy("case_id").agg(
        F.max("iqr_fraction").alias("max_control_iqr_fraction")
    )
    ranges = compared.groupBy("case_id").agg(
        F.count("*").alias("runs"),
        F.min("ratio").alias("min_ratio"),
        F.max("ratio").alias("max_ratio"),
        F.min(F.col("absolute_saving_us") / 1000).alias("min_saving_ms"),
        F.max(F.col("absolute_saving_us") / 1000).alias("max_saving_ms"),
        F.max("drift_fraction").alias("max_drift_fraction"),
    )
    return ranges.join(control, "case_id", "left")


def _explode_problems(df: DataFrame, keys: list[str], problems: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def validate_runs(runs: DataFrame) -> DataFrame:
    """(case_id, run, problem): every way a run breaks the protocol."""
    label = F.concat(F.col("case_id"), F.lit(" run "), F.col("run"))
    problems = [
        F.when(
            ~F.col("protocol.warmups").eqNullSafe(F.lit(WARMUPS)),
            F.concat(label, F.lit(f": declared warmups != {WARMUPS}")),
        ),
        F.when(
            ~F.col("protocol.samples").eqNullSafe(F.lit(SAMPLES)),
            F.concat(label, F.lit(f": declared samples != {SAMPLES}")),
        ),
        F.when(
            ~F.col("units").eqNullSafe(F.lit("microseconds")),
            F.concat(label, F.lit(": units must be microseconds")),
        ),
    ]
    for name in ARMS:
        arm = F.try_element_at("arms", F.lit(name))
        problems.append(F.when(arm.isNull(), F.concat(label, F.lit(f": missing arm {name}"))))
        for kind, expected in (("warmups", WARMUPS), ("samples", SAMPLES)):
            values = arm[kind]
            got = F.coalesce(F.size(values).cast("string"), F.lit("missing"))
            miscounted = values.isNull() | (F.size(values) != expected)
            positive = F.forall(values, lambda v: v.isNotNull() & (v > 0))
            problems.append(
                F.when(
                    arm.isNotNull() & miscounted,
                    F.concat(label, F.lit(f" {name}: {kind} count is "), got, F.lit(f", expected {expected}")),
                ).when(
                    arm.isNotNull() & ~positive,
                    F.concat(label, F.lit(f" {name}: {kind} must be positive integer microseconds")),
                )
            )
    return _explode_problems(runs, RUN, problems)


def run_inventory_check(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, run, problem): each expected run exactly once, and nothing else."""
    observed = runs.groupBy(*RUN).agg(F.count("*").alias("n"))
    known_cases = expected.select("case_id").distinct().withColumn("known", F.lit(True))
    joined = (
        expected.select(*RUN)
        .distinct()
        .withColumn("wanted", F.lit(True))
        .join(observed, RUN, "full_outer")
        .join(known_cases, "case_id", "left")
    )
    case, run = F.col("case_id"), F.col("run").cast("string")
    problem = (
        F.when(
            F.col("wanted") & F.col("n").isNull(),
            F.concat(case, F.lit(": run "), run, F.lit(" is missing from the inventory")),
        )
        .when(
            F.col("wanted") & (F.col("n") > 1),
            F.concat(case, F.lit(": run "), run, F.lit(" appears "), F.col("n"), F.lit(" times")),
        )
        .when(
            F.col("known").isNull(),
            F.concat(F.lit("unexpected case "), case, F.lit(" in the inventory")),
        )
        .when(
            F.col("wanted").isNull(),
            F.concat(case, F.lit(": unexpected run "), run, F.lit(" in the inventory")),
        )
    )
    return joined.select(*RUN, problem.alias("problem")).where("problem IS NOT NULL")


@dataclass(frozen=True)
class Declared:
    """The declared environment every run must agree with."""

    image_digest: str
    version: str
    client: dict[str, str]
    python: str
    dataset: dict[str, int]
    session_settings: list[str]


def provenance_check(runs: DataFrame, declared: Declared, cases: DataFrame) -> DataFrame:
    """(case_id, run, problem): every difference from the declared sources.

    `cases` holds (case_id, sql, params, index_name, ddl).
    """
    c = cases.select("case_id", F.struct("sql", "params", "index_name", "ddl").alias("case"))
    joined = runs.join(c, "case_id", "left")
    label = F.concat(F.col("case_id"), F.lit(" run "), F.col("run"))
    case = F.col("case")
    client = [
        F.when(
            ~F.try_element_at("client", F.lit(name)).eqNullSafe(F.lit(version)),
            F.concat(label, F.lit(f": {name} is not the locked {version}")),
        )
        for name, version in declared.client.items()
    ]
    dataset = F.array_sort(
        F.array(
            *[
                F.struct(F.lit(k).alias("key"), F.lit(v).cast("bigint").alias("value"))
                for k, v in declared.dataset.items()
            ]
        )
    )

    def differs(value: Column, wanted: Column, text: str) -> Column:
        return F.when(~value.eqNullSafe(wanted), F.concat(label, F.lit(f": {text}")))

    python = F.coalesce(F.try_element_at("client", F.lit("python")), F.lit(""))
    settings = F.coalesce(F.col("session_settings"), F.array())
    problems = F.array(
        differs(F.col("server.image_digest"), F.lit(declared.image_digest), "image digest is not the declared one"),
        differs(F.col("server.version"), F.lit(declared.version), "server version is not the declared one"),
        F.when(
            ~python.startswith(declared.python),
            F.concat(label, F.lit(": python does not match the declared version")),
        ),
        differs(
            F.array_sort(F.map_entries("dataset")), dataset, "dataset is not the declared dataset"
        ),
        differs(settings, F.array(*[F.lit(x) for x in declared.session_settings]), "session settings differ from the declared settings"),
        F.when(case.isNull(), F.concat(label, F.lit(": no matching entry in the cases"))),
        F.when(case.isNotNull(), differs(F.col("query.sql"), case["sql"], "measured SQL differs from the case")),
        F.when(
            case.isNotNull(),
            differs(F.coalesce(F.col("query.params"), F.array()), case["params"], "measured parameters differ from the case"),
        ),
        F.when(case.isNotNull(), differs(F.col("index.name"), case["index_name"], "index is not the declared one")),
        F.when(case.isNotNull(), differs(F.col("index.ddl"), case["ddl"], "index DDL differs from the case")),
    )
    return joined.select(
        *RUN, F.explode(F.array_compact(F.concat(problems, F.array(*client)))).alias("problem")
    )


def session_consistency(runs: DataFrame, session: list[str]) -> DataFrame:
    """(session keys, field, distinct_values) for each field the session's runs disagree on."""
    fields = ["host", "client", "server", "session_settings", "recorded_at"]

    def text(name: str) -> Column:
        value = F.col(name)
        if name in ("host", "client"):
            value = F.array_sort(F.map_entries(value))
        return F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("null"))

    pairs = F.array(*[F.struct(F.lit(n).alias("field"), text(n).alias("value")) for n in fields])
    return (
        runs.select(*session, F.inline(pairs))
        .distinct()
        .groupBy(*session, "field")
        .agg(F.count("*").alias("distinct_values"))
        .where("distinct_values > 1")
    )


def nplus1_evidence(broken: DataFrame, clean: DataFrame, key: str, clean_expected: int = 2) -> DataFrame:
    """(key, problem): 1 + N statements on one side, a fixed count on the other, same results.

    Both sides hold `key`, orders_returned, select_statements, order_ids, totals_checksum.
    """
    b = broken.select(key, F.struct(*[c for c in broken.columns if c != key]).alias("b"))
    c = clean.select(key, F.struct(*[c for c in clean.columns if c != key]).alias("c"))
    left, right = F.col("b"), F.col("c")
    both = left.isNotNull() & right.isNotNull()
    returned = F.coalesce(left["orders_returned"], F.lit(0))

    def differs(name: str, wanted: Column) -> Column:
        return both & ~right[name].eqNullSafe(wanted)

    problems = [
        F.when(left.isNull(), "missing entry for the broken side"),
        F.when(right.isNull(), "missing entry for the clean side"),
        F.when(both & (returned <= 0), "broken returned no orders, so the counts prove nothing"),
        F.when(
            differs("orders_returned", left["orders_returned"]),
            "fixtures returned different row counts",
        ),
        F.when(both & ~left["select_statements"].eqNullSafe(1 + returned), "broken is not 1+N"),
        F.when(
            differs("select_statements", F.lit(clean_expected)),
            f"clean is not a fixed count of {clean_expected}",
        ),
        F.when(
            differs("order_ids", left["order_ids"]), "order ids differ between fixtures"
        ),
        F.when(
            differs("totals_checksum", left["totals_checksum"]),
            "totals checksums differ between fixtures",
        ),
    ]
    return _explode_problems(b.join(c, key, "full_outer"), [key], problems)


def write_cost_delta(measurements: DataFrame, builds: DataFrame | None = None) -> DataFrame:
    """Before, after and difference per (candidate, operation) of recorded write measurements.

    `builds` adds the build time and size of each candidate's index.
    """
    deltas = _write_deltas(measurements)
    if builds is None:
        return deltas
    return deltas.join(builds.select("candidate", "build_us", "index_size_bytes"), "candidate", "left")


def _write_deltas(measurements: DataFrame) -> DataFrame:
    wide = (
        measurements.groupBy("candidate", "operation")
        .pivot("phase", ["before", "after"])
        .agg(F.max("execution_us").alias("execution_us"), F.max("wal_bytes").alias("wal_bytes"))
    )
    return wide.select(
        "candidate",
        "operation",
        F.col("before_execution_us").alias("execution_us_before"),
        F.col("after_execution_us").alias("execution_us_after"),
        (F.col("after_execution_us") - F.col("before_execution_us")).alias("execution_us_delta"),
        F.col("before_wal_bytes").alias("wal_bytes_before"),
        F.col("after_wal_bytes").alias("wal_bytes_after"),
        (F.col("after_wal_bytes") - F.col("before_wal_bytes")).alias("wal_bytes_delta"),
    )


def verified_candidates(
    verdicts: DataFrame, write_costs: DataFrame, min_ratio: float = MIN_VERIFIED_RATIO
) -> DataFrame:
    """Read benefit beside write cost per candidate; never a keep or drop verdict.

    `verdicts` holds candidate, inconclusive and ratio.
    """
    verified = ~F.col("inconclusive") & F.coalesce(F.col("ratio") >= min_ratio, F.lit(False))
    return verdicts.withColumn("read_benefit_verified", verified).join(write_costs, "candidate")


def reproduction_verdict(recorded: DataFrame, renewed: DataFrame) -> DataFrame:
    """Whether a new experiment repeats a recorded one, per proof.

    `recorded` holds proof_id, control_us, treatment_us, plan_fingerprint; `renewed` holds
    proof_id, ratio, inconclusive, new_plan_fingerprint. Unknown facts stay null.
    """
    original = F.try_divide(F.col("control_us"), F.col("treatment_us")) > 1.0
    again = F.coalesce(F.col("ratio") > 1.0, F.lit(False))
    direction = original == again
    plan = F.col("plan_fingerprint") == F.col("new_plan_fingerprint")
    stable = ~F.col("inconclusive")
    return (
        recorded.join(renewed, "proof_id")
        .withColumn("direction_matches", direction)
        .withColumn("plan_shape_compatible", plan)
        .withColumn("stable", stable)
        .withColumn(
            "reproduced",
            F.coalesce(direction, F.lit(False)) & stable & F.coalesce(plan, F.lit(True)),
        )
    )


def proof_summary_check(proofs: DataFrame) -> DataFrame:
    """(id, problem) for proof rows whose verdict lacks what it must state."""
    missing = F.array_sort(
        F.array_except(F.array(*[F.lit(a) for a in ARMS]), F.coalesce("arms", F.array()))
    )
    verified = F.col("verdict") == "verified_in_fixture"
    problems = [
        F.when(
            verified & (F.size(missing) > 0),
            F.concat(
                F.lit("verified_in_fixture requires control, treatment and drift arms; missing "),
                F.array_join(missing, ", "),
            ),
        ),
        F.when(
            verified & F.col("absolute_saving_us").isNull(),
            "verified_in_fixture requires an absolute saving",
        ),
        F.when(
            (F.col("verdict") == "rejected") & F.col("rejection_reason").isNull(),
            "a rejected candidate must state why",
        ),
        F.when(
            (F.col("verdict") == "inconclusive") & F.col("stability_note").isNull(),
            "an inconclusive result must state its instability",
        ),
        F.when(
            ~F.col("id").startswith(F.concat(F.col("recommendation"), F.lit("@"))),
            "proof id must be its recommendation plus the input-manifest hash",
        ),
    ]
    return _explode_problems(proofs, ["id"], problems)


def drift_both_ways(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows only one side has, with `side`; duplicates count."""
    columns = stored.columns
    right = computed.select(*columns)
    return (
        stored.exceptAll(right)
        .withColumn("side", F.lit("stored"))
        .unionByName(right.exceptAll(stored).withColumn("side", F.lit("computed")))
    )


def parameters_available(proofs: DataFrame) -> DataFrame:
    """Add `available`: every descriptor is revealed and carries its value."""
    shown = F.forall(
        F.coalesce("parameters", F.array()),
        lambda p: ~F.coalesce(p["is_redacted"], F.lit(True)) & p["redacted_value"].isNotNull(),
    )
    return proofs.withColumn("available", shown)
