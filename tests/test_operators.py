"""Named behaviours of the remaining operators on tiny inputs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import identity
from fleetlens.operators import (
    candidates,
    context,
    generate,
    measure,
    plan_trees,
    profile,
    quality,
    rules,
    treatment,
)
from fleetlens.sources import bench_runs, capture, files


def samples(spark, arms):
    rows = [("c", 1, arm, "sample", i, v, 20) for arm, values in arms.items() for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "case_id string, run int, arm string, kind string, idx int, value_us bigint, rows bigint"
    )


# Golden values: raw timings of one recorded run and the figures published for it.
GOLDEN = {
    "control_a1": [10293, 10099, 11565, 9884, 9461, 9287, 9274],
    "treatment_b": [247, 276, 281, 286, 289, 291, 296],
    "drift_control_a2": [8985, 9039, 9257, 9299, 9337, 9343, 9369],
}


def test_golden_statistics(spark):
    stats, problems = measure.arm_statistics(samples(spark, GOLDEN))
    assert problems.isEmpty()
    a1 = stats.where("arm = 'control_a1'").first()
    assert (a1.median_us, a1.q1_us, a1.q3_us, a1.min_us, a1.max_us) == (9884, 9287, 10293, 9274, 11565)
    assert a1.iqr_fraction == pytest.approx(0.10178065560501821)
    assert a1.mean_us == pytest.approx(9980.42857142857)
    run = measure.experiment_verdict(stats).first()
    assert run.ratio == pytest.approx(34.6, abs=0.05)
    assert run.drift_fraction == pytest.approx(0.0592, abs=1e-4)
    assert not run.inconclusive


def test_wrong_sample_count_is_a_problem_and_leaves_the_run_incomplete(spark):
    arms = dict(GOLDEN, treatment_b=[1, 2, 3])
    stats, problems = measure.arm_statistics(samples(spark, arms))
    assert problems.first().problem == "expected 7 samples, got 3"
    verdict = measure.experiment_verdict(stats).first()
    assert verdict.inconclusive and verdict.ratio is None and not verdict.complete


@pytest.mark.parametrize(("third", "drift"), [(110, False), (111, True)])
def test_drift_gate_is_strict(spark, third, drift):
    arms = {"control_a1": [100] * 7, "treatment_b": [50] * 7, "drift_control_a2": [third] * 7}
    stats, _ = measure.arm_statistics(samples(spark, arms))
    assert measure.experiment_verdict(stats).first().drift_detected is drift


def test_bench_documents(spark):
    good = {"case_id": "c", "run": 1, "arms": {"control_a1": {"samples": [1, 2], "warmups": [3], "rows": 1}}}
    texts = [("a", json.dumps(good)), ("b", "{"), ("c", json.dumps({"case_id": "c", "run": 1}))]
    runs, problems = bench_runs.parse_bench_documents(spark.createDataFrame(texts, "file string, value string"))
    assert [r.file for r in runs.collect()] == ["a"]
    assert {r.file: r.problem for r in problems.collect()} == {
        "b": "unreadable or malformed JSON",
        "c": "missing required field 'arms'",
    }
    assert bench_runs.long_samples(runs).count() == 3


def plan(spark, tree):
    df = spark.createDataFrame([("d", json.dumps([{"Plan": tree}]))], "k string, doc string")
    return plan_trees.plan_fingerprints(df, ["k"]).join(plan_trees.plan_shapes(df, ["k"]), "k").first()


def test_plan_identity_ignores_costs_but_not_indexes(spark):
    scan = {"Node Type": "Index Scan", "Relation Name": "o", "Index Name": "i"}
    base = plan(spark, {"Node Type": "Limit", "Plans": [scan]})
    assert base.normalized_shape == "Limit -> (Index Scan using i)"
    assert plan(spark, {"Node Type": "Limit", "Plans": [scan | {"Total Cost": 9.5, "Filter": "x"}]}).plan_fingerprint == base.plan_fingerprint
    assert plan(spark, {"Node Type": "Limit", "Plans": [scan | {"Index Name": "j"}]}).plan_fingerprint != base.plan_fingerprint
    broken = spark.createDataFrame([("d", "no json")], "k string, doc string")
    assert plan_trees.plan_fingerprints(broken, ["k"]).first().plan_fingerprint is None


PREDICATES = "app_id string, query_id string, ordinal int, table_id string, column_id string, kind string"


def judged(spark, predicates, sequences):
    p = spark.createDataFrame([("a", "q", *row) for row in predicates], PREDICATES)
    s = spark.createDataFrame(
        [("a", "public.t", (0, n), n, cols) for n, cols in sequences],
        "app_id string, table_id string, priority struct<source:int,name:string>, name string, sequence array<string>",
    )
    rows = candidates.judge_candidates(p, s, ["app_id", "query_id"]).orderBy("table_order", "shape_order").collect()
    return [(",".join(c.split(".")[-1] for c in r.columns), r.reason) for r in rows]


def column(i, name, kind="equality"):
    return (i, "public.t", f"public.t.{name}", kind)


def test_composites_come_first(spark):
    got = judged(spark, [column(1, "a"), column(2, "b"), column(3, "c", "numeric_range")], [("x", ["public.t.z"])])
    assert got == [("a,b,c", None), ("a,b", None), ("a", None), ("b", None), ("c", None)]


def test_prefix_of_an_existing_key_is_a_duplicate_and_costs_no_budget(spark):
    rows = [column(i, n) for i, n in enumerate("abcdefg")]
    got = judged(spark, rows, [("k", ["public.t.a", "public.t.z"])])
    assert got[1] == ("a", "duplicate_of_existing_index:k")
    assert [reason for _, reason in got].count(None) == 5
    assert got[-1] == ("g", "over_candidate_budget")


def test_candidate_ddl(spark):
    df = spark.createDataFrame([("public.t", ["public.t.a", "public.t.b"])], "table_id string, columns array<string>")
    got = candidates.candidate_ddl(df).first()
    assert got.apply_sql == 'CREATE INDEX ix_t_a_b ON "public"."t" (a, b)'
    assert got.revert_sql == 'DROP INDEX "public"."ix_t_a_b"'


def test_treatment_absent_side_is_not_reduced(spark):
    ops = "app_id string, operation_id string, query_count bigint, duration_us bigint"
    runs = "app_id string, selected_tests bigint, failed_tests bigint"
    base = spark.createDataFrame([("a", "o", 21, 5), ("a", "gone", 2, 1)], ops)
    new = spark.createDataFrame([("a", "o", 2, 4)], ops)
    fine = spark.createDataFrame([("a", 3, 0)], runs)
    failing = spark.createDataFrame([("a", 3, 1)], runs)
    got = {r.operation_id: r for r in treatment.compare_treatment(base, new, fine, fine).collect()}
    assert got["o"].verified and got["o"].amplification_reduced
    assert got["gone"].amplification_reduced is None and not got["gone"].verified
    assert got["gone"].unsupported_reason == "operation absent from the treatment capture"
    worse = {r.operation_id: r for r in treatment.compare_treatment(base, new, fine, failing).collect()}
    assert worse["o"].unsupported_reason is None and not worse["o"].results_equivalent


def test_equality_probe_median_is_the_upper_middle(spark):
    df = spark.createDataFrame([("x",)] * 1 + [("y",)] * 3 + [("z",)] * 3 + [("w",)] * 9 + [(None,)], "c string")
    rows = profile.equality_probes(profile.frequencies(df, ["c"], "string")).collect()
    assert {r.method: (r.value, r.row_count) for r in rows} == {
        "highly_selective": ("x", 1), "moderate_selectivity": ("y", 3), "most_common_value": ("w", 9),
    }
    many = spark.range(30).select(F.col("id").cast("string").alias("c"))
    freq = profile.frequencies(many, ["c"], "string")
    assert profile.equality_probes(freq, 29).isEmpty()
    assert profile.equality_probes(freq).count() == 3
    assert [tuple(r) for r in profile.unprobed_columns(freq, 29).collect()] == [
        ("c", 30, "30 distinct values, more than 29")
    ]
    assert profile.unprobed_columns(freq, 30).isEmpty()


@pytest.mark.parametrize("values", [range(1, 11), range(11), [2] * 9 + [5], [7], [1, 1, 2, 3, 3, 3, 8]])
def test_range_counts_are_those_of_the_operator(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "c double")
    kinds = [profile.Predicate("t", "c", i, op, "numeric_range") for i, op in enumerate((">", ">=", "<", "<="))]
    cutoffs = profile.ranked_cutoffs(profile.frequencies(df, ["c"], "double"))
    rows = profile.numeric_range_probes(cutoffs, kinds).collect()
    holds = {">": lambda v, c: v > c, ">=": lambda v, c: v >= c, "<": lambda v, c: v < c, "<=": lambda v, c: v <= c}
    assert len(rows) == 12
    for r in rows:
        assert r.row_count == sum(holds[r.operator](v, r.cutoff) for v in values)


def test_percentiles_interpolate(spark):
    freq = profile.frequencies(spark.range(1, 11).select(F.col("id").alias("c")), ["c"], "double")
    got = profile.percentile_cutoffs(freq).first()
    assert (got.low, got.mid, got.high) == pytest.approx((1.9, 5.5, 9.1))


@pytest.mark.parametrize(
    "text", ["a", "a.b", "a\\b", "..", "\\", "é.\\.", "a" * 50_000 + "." + "\\." * 9_000]
)
def test_identity_round_trip(spark, text):
    df = spark.createDataFrame([(text, "t")], "s string, t string")
    coded = df.select(identity.encode_identity("s", "t").alias("i"))
    assert coded.select(identity.decode_identity("i").alias("d")).first().d == [text, "t"]


@pytest.mark.parametrize("text", ["a.", ".a", "a..b", "a\\", "a\\x.b", ""])
def test_bad_identities_are_refused(spark, text):
    df = spark.createDataFrame([(text,)], "i string")
    assert df.select(identity.decode_identity("i").alias("d")).first().d is None


def test_capture_lines_survive_bad_neighbours(spark):
    good = {
        "sequence": 1, "duration_us": 2, "statement": "s", "dialect": "d", "node_id": "n", "phase": "call",
        "process_id": 1, "thread_id": 1, "later_field": True,
    }
    lines = [json.dumps(good), "{", "", json.dumps(good | {"phase": "other"}), json.dumps(good | {"duration_us": -1})]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    assert [r.is_valid for r in capture.parse_capture_lines(df).collect()] == [True, False, False, False]


def test_capture_folder(spark, tmp_path):
    (tmp_path / "one.ndjson").write_text('{"sequence": 1}\n\nnot json\n')
    events, malformed = capture.read_capture_events(spark, str(tmp_path))
    assert events.isEmpty()
    assert malformed.first().malformed_lines == 2


def _taken(sizes, budget):
    left, out = budget, set()
    for path, size in sorted(sizes.items()):
        if size <= left:
            left -= size
            out.add(path)
    return out


def test_file_inventory_takes_few_rounds(spark, monkeypatch):
    calls, plain = [], files.materialize

    def counted(df, label):
        calls.append(label)
        return plain(df, label)

    monkeypatch.setattr(files, "materialize", counted)
    rnd = random.Random(2)
    apps = {f"r{k}": {f"p{i:03}": rnd.choice([0, 1, 2, 3, 5, 8, 40, 90]) for i in range(60)} for k in range(12)}
    # Every second file is a byte too large for what is left.
    apps["misfits"], left = {}, 1_000_000
    for i in range(0, 10_000, 2):
        apps["misfits"] |= {f"p{i:05}": 50 + i % 7, f"p{i + 1:05}": left - 49 - i % 7}
        left -= 50 + i % 7
    rows = [(app, path, size) for app, sizes in apps.items() for path, size in sizes.items()]
    df = spark.createDataFrame(rows, "app_id string, path string, size long")
    for app, budget in (("misfits", 1_000_000), ("r", 100)):
        calls.clear()
        got = files.file_inventory(df.where(F.col("app_id").startswith(app)), max_file=10**7, max_total=budget).collect()
        taken = {(r.app_id, r.path) for r in got if r.reason is None}
        assert taken == {(a, p) for a, sizes in apps.items() if a.startswith(app) for p in _taken(sizes, budget)}
        assert calls.count("totals") <= 28


def test_file_inventory_skips_and_goes_on(spark):
    rows = [("a", "1.py", 60), ("a", "2.py", 50), ("a", "3.py", 30), ("a", "4.py", 20), ("a", "5.py", 10), ("b", ".git/x", 1), ("b", ".env", 1), ("b", "m.pyc", 1)]
    df = spark.createDataFrame(rows, "app_id string, path string, size bigint")
    got = {r.path: r.reason for r in files.file_inventory(df, max_file=70, max_total=100).collect()}
    assert [p for p, reason in got.items() if reason is None and p.endswith(".py")] and got["1.py"] is None
    assert {p for p, reason in got.items() if reason == "total size limit reached"} == {"2.py", "4.py"}
    assert got[".git/x"] == "excluded: .git/" and got[".env"] == "excluded: .env" and got["m.pyc"] == "excluded: .pyc file"


def test_read_files(spark, tmp_path):
    (tmp_path / "app" / "src").mkdir(parents=True)
    (tmp_path / "app" / "src" / "a.py").write_text("x")
    got = files.read_files(spark, f"file:{tmp_path}").first()
    assert (got.app_id, got.path, got.size) == ("app", "src/a.py", 1)
    assert got.content_hash == "sha256:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


@pytest.mark.parametrize(
    ("text", "kind", "literals", "low", "high"),
    [
        ("(status = ANY (ARRAY['b'::text, 'a'::text]))", "set", ["a", "b"], None, None),
        ("((a = 1) OR (a = 2))", "set", ["1", "2"], None, None),
        ("((qty >= 1) AND (qty <= 9))", "range", None, 1, 9),
        ("(qty > 5)", "range", None, 6, 1_000_006),
        ("qty BETWEEN 3 AND 2", None, None, None, None),
        ("((a = 1) OR (b = 2))", None, None, None, None),
        ("(NOT (qty > 5))", None, None, None, None),
        ("(lower(name) = 'x')", None, None, None, None),
        ("((qty > 1) AND (name IS NOT NULL))", None, None, None, None),
    ],
)
def test_checks(spark, text, kind, literals, low, high):
    got = generate.recognize_checks(spark.createDataFrame([(text,)], "expression string")).first()
    assert (got.check_kind, got.literals, got.low, got.high) == (kind, literals, low, high)


def test_unique_values_avoid_existing(spark):
    held = spark.range(1, 900).select(F.col("id").alias("v"))
    got = [r.value for r in generate.unique_values(spark, 12345, 400, held).collect()]
    assert len(set(got)) == 400 and min(got) >= 900


def test_streams_do_not_depend_on_the_rest():
    seed = generate.component_seed(1, "public.t", "public.t.a", 1)
    assert seed == generate.component_seed(1, "public.t", "public.t.a", 1)
    assert seed != generate.component_seed(2, "public.t", "public.t.a", 1)
    assert seed != generate.component_seed(1, "public.t", "public.t.b", 1)


def test_second_load_adds_nothing(spark, tmp_path):
    spec = generate.TableSpec("t", 30, (generate.ColumnSpec("id", "bigint", "unique_sequential_int"),))
    assert generate.load_dataset(spark, [spec], str(tmp_path), 1, "2026-01-01 00:00:00") == {"t": (0, 30)}
    assert generate.load_dataset(spark, [spec], str(tmp_path), 1, "2026-01-01 00:00:00") == {"t": (30, 0)}


def test_context_keeps_earlier_fields(spark):
    rows = [
        ("a", 1, "core_rpo_rto", "answered", "5m, 30m"),
        ("a", 2, "core_rpo_rto", "unknown", None),
        ("a", 3, "core_read_write_mix", "answered", "80:20, many"),
        ("a", 4, "core_tenant_model", "answered", "nonsense"),
        ("a", 5, "core_retention", "answered", " gdpr , ,audit "),
    ]
    answers = spark.createDataFrame(rows, "app_id string, pos int, question string, state string, value string")
    got = context.derive_context(answers).first()
    assert (got.rpo, got.rto, got.read_write_ratio, got.peak_requests_per_second) == ("5m", "30m", "80:20", None)
    assert got.tenant_model == "unknown" and got.retention_constraints == ["gdpr", "audit"]
    folded = {r.question: r.state for r in context.fold_answers(answers).collect()}
    assert folded["core_rpo_rto"] == "unknown"


def test_leak_scan(spark):
    texts = spark.createDataFrame(
        [(1, "the secret key-42 lies here"), (2, "mysecretive"), (3, None), (4, "")], "text_id int, text string"
    )
    needles = spark.createDataFrame(
        [("a", "secret"), ("b", "key-42 lies"), ("c", ""), ("d", "e"), ("e", "absent words here"), ("f", "secret"), ("f", "secret"), ("g", "ec"), ("h", "e h"), ("i", None)],
        "needle_id string, needle string",
    )
    want = {(1, "a"), (2, "a"), (1, "b"), (1, "d"), (2, "d"), (1, "f"), (2, "f"), (1, "g"), (2, "g")}
    assert sorted(tuple(r) for r in quality.leak_scan(texts, needles).collect()) == sorted(want)


def test_registered_rules_run(spark):
    rows = spark.createDataFrame([("a", "x")], "app_id string, question string")
    rule = rules.Rule("test.always", 1, lambda ctx: rules.RuleOutput(questions=ctx["rows"]))
    out = rules.run_rules({"rows": rows}, [rule])
    assert out.findings is None and out.questions.count() == 1
    with pytest.raises(ValueError):
        rules.register_rule(rules.UNINDEXED, 2, rule.evaluate)
