"""Experiment statistics, evidence and plan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import measure, plan_trees
from fleetlens.plans.partitions import spread
from fleetlens.registry.base import query
from fleetlens.registry.inputs import define, frame, table
from fleetlens.sources import bench_runs
from fleetlens.sources.scratch import new_path

# Every 21 events are one experiment run: three arms of seven timings.
define(
    "bench_samples",
    """
SELECT b, concat('case-', b % 40) AS case_id, CAST(floor(b / 40) AS BIGINT) + 1 AS run,
  CASE WHEN slot < 7 THEN 'control_a1' WHEN slot < 14 THEN 'treatment_b' ELSE 'drift_control_a2' END AS arm,
  CASE WHEN value < 0.6 THEN 'warmup' ELSE 'sample' END AS kind, slot % 7 AS idx,
  CAST(round(value * 5) AS BIGINT) + CASE WHEN slot >= 7 AND slot < 14 THEN 1500 ELSE 3000 END AS value_us, 20 AS rows
FROM (SELECT CAST(floor(event_id / 21) AS BIGINT) AS b, event_id % 21 AS slot, value FROM {events}) e
""",
)
_STATS = """l AS (SELECT case_id, run, arm, list_sort(list(value_us)) AS s FROM bench_samples WHERE kind = 'sample' GROUP BY ALL HAVING count(*) = 7),
    st AS (SELECT case_id, run, arm, CAST(s[4] AS DOUBLE) AS median_us, CAST(s[1] AS DOUBLE) AS min_us, CAST(s[7] AS DOUBLE) AS max_us,
      CAST(s[2] AS DOUBLE) AS q1_us, CAST(s[6] AS DOUBLE) AS q3_us, list_sum(s) / 7 AS mean_us, (s[6] - s[2]) / s[4] AS iqr_fraction FROM l),
    cm AS (SELECT case_id, run, max(median_us) FILTER (WHERE arm = 'control_a1') AS a1, max(median_us) FILTER (WHERE arm = 'treatment_b') AS b,
      max(median_us) FILTER (WHERE arm = 'drift_control_a2') AS a2, bool_or(iqr_fraction > 0.25) AS high_variance FROM st GROUP BY ALL)"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics, _problems = measure.arm_statistics(frame(spark, sf_dir, "bench_samples"))
    return statistics


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "b02_arm_statistics",
    inputs="bench_samples",
    sql=f"""WITH {_STATS} SELECT case_id, run, arm, median_us, min_us, max_us, q1_us, q3_us, round(mean_us, 6) AS mean_us,
      round(iqr_fraction, 6) AS iqr_fraction, iqr_fraction > 0.25 AS high_variance FROM st""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_statistics(spark, sf_dir), "mean_us", "iqr_fraction").drop("row_count")


@query(
    "b02_arm_problems",
    inputs="bench_samples",
    sql="""SELECT case_id, run, arm, concat('expected 7 samples, got ', count(*)) AS problem FROM bench_samples
    WHERE kind = 'sample' GROUP BY ALL HAVING count(*) <> 7""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.arm_statistics(frame(spark, sf_dir, "bench_samples"))[1]


@query(
    "b03_compare_arms",
    inputs="bench_samples",
    sql=f"""WITH {_STATS} SELECT case_id, run, a1 - b AS absolute_saving_us, round(a1 / b, 6) AS ratio,
      round(abs(a2 - a1) / a1, 6) AS drift_fraction, a1 IS NOT NULL AND b IS NOT NULL AND a2 IS NOT NULL AS complete FROM cm""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measure.compare_arms(_statistics(spark, sf_dir)), "ratio", "drift_fraction")


_VERDICT = """v AS (SELECT *, a1 IS NOT NULL AND b IS NOT NULL AND a2 IS NOT NULL AS complete FROM cm),
    vd AS (SELECT case_id, run, high_variance, complete, CASE WHEN complete THEN a1 - b END AS absolute_saving_us,
      CASE WHEN complete THEN a1 / b END AS ratio, CASE WHEN complete THEN abs(a2 - a1) / a1 END AS drift_fraction FROM v),
    ve AS (SELECT *, coalesce(drift_fraction > 0.1, false) AS drift_detected,
      NOT complete OR high_variance OR coalesce(drift_fraction > 0.1, false) AS inconclusive FROM vd)"""


@query(
    "b04_experiment_verdict",
    inputs="bench_samples",
    sql=f"""WITH {_STATS}, {_VERDICT} SELECT case_id, run, high_variance, complete, absolute_saving_us, round(ratio, 6) AS ratio,
      round(drift_fraction, 6) AS drift_fraction, drift_detected, inconclusive FROM ve""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(measure.experiment_verdict(_statistics(spark, sf_dir)), "ratio", "drift_fraction")


_SUMMARY = f"""WITH {_STATS}, cp AS (SELECT case_id, run, a1 - b AS s, a1 / b AS r, abs(a2 - a1) / a1 AS d FROM cm),
    ci AS (SELECT case_id, max(iqr_fraction) AS m FROM st WHERE arm = 'control_a1' GROUP BY 1)
    SELECT cp.case_id, count(*) AS runs, round(min(r), 6) AS min_ratio, round(max(r), 6) AS max_ratio, round(min(s / 1000), 6) AS min_saving_ms,
      round(max(s / 1000), 6) AS max_saving_ms, round(max(d), 6) AS max_drift_fraction, round(max(m), 6) AS max_control_iqr_fraction
    FROM cp LEFT JOIN ci USING (case_id) GROUP BY 1"""


@query("b05_case_summary", inputs="bench_samples", sql=_SUMMARY)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = measure.case_summary(_statistics(spark, sf_dir))
    return _rounded(summary, *[c for c in summary.columns if c not in ("case_id", "runs")])


def bench_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, value): one JSON run document per experiment block, some of them faulty."""
    arms = (
        frame(spark, sf_dir, "bench_samples")
        .groupBy("b", "case_id", "run", "arm")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "value_us")))["value_us"].alias("samples"))
        .withColumn("warmups", F.expr("IF(b % 9 = 0, array(3001, 3002), array(3001, 3002, 3003))"))
        .groupBy("b", "case_id", "run")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("arm", F.struct("warmups", "samples", F.lit(20).alias("rows"))))
            ).alias("arms")
        )
    )
    text = F.to_json(
        F.struct(
            "case_id",
            F.expr("IF(b % 19 = 0, NULL, run)").alias("run"),
            F.expr("IF(b % 3 = 0, 't1', 't0')").alias("recorded_at"),
            F.expr("IF(b % 11 = 0, 'milliseconds', 'microseconds')").alias("units"),
            F.expr("struct(3 AS warmups, IF(b % 13 = 0, 6, 7) AS samples)").alias("protocol"),
            F.expr("struct(IF(b % 31 = 0, 'SELECT 2', 'SELECT 1') AS sql, array('42') AS params)").alias("query"),
            F.expr("struct(IF(b % 37 = 0, 'ix_b', 'ix_a') AS name, 'CREATE INDEX ix_a' AS ddl)").alias("index"),
            F.expr("map('orders', IF(b % 23 = 0, 399999, 400000))").alias("dataset"),
            F.expr("struct(IF(b % 7 = 0, '16.4', '17.11') AS version, 'sha256:aa' AS image_digest)").alias("server"),
            F.expr("map('python', IF(b % 5 = 0, '3.12.1', '3.13.5'), 'psycopg', IF(b % 6 = 0, '3.2', '3.3'))").alias("client"),
            F.expr("map('os', 'Linux')").alias("host"),
            F.expr("IF(b % 29 = 0, array(), array('SET jit = off'))").alias("session_settings"),
            "arms",
        )
    )
    cut = F.when(F.col("b") % 17 == 0, F.substring(text, 1, 120)).otherwise(text)
    return arms.select("b", cut.alias("value"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bench_documents(spark, sf_dir).withColumn("file", F.concat(F.lit("run-"), "b"))
    return bench_runs.parse_bench_documents(documents)[0]


_BLOCKS = "blk AS (SELECT DISTINCT b, case_id, run FROM bench_samples), ok AS (SELECT * FROM blk WHERE b % 17 <> 0 AND b % 19 <> 0)"


@query(
    "b01_read_bench_runs",
    inputs="bench_samples",
    sql=f"""WITH {_BLOCKS} SELECT s.case_id, s.run, s.arm, 'sample' AS kind, CAST(idx AS BIGINT) AS idx, value_us, CAST(20 AS BIGINT) AS rows
      FROM bench_samples s JOIN ok USING (b)
    UNION ALL SELECT DISTINCT s.case_id, s.run, s.arm, 'warmup', w - 1, 3000 + w, 20 FROM bench_samples s JOIN ok USING (b), range(1, 4) r(w) WHERE w < 3 OR b % 9 <> 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "bench-runs")
    bench_runs.write_bench_sequences(bench_documents(spark, sf_dir), path)
    runs, _problems = bench_runs.read_bench_runs(spark, path, sequences=True)
    # Positions inside an arm are dense; a short arm starts at its own first slot.
    samples = bench_runs.long_samples(runs)
    return samples


@query(
    "b01_bench_run_problems",
    inputs="bench_samples",
    sql=f"""WITH {_BLOCKS} SELECT concat('run-', b) AS file, CASE WHEN b % 17 = 0 THEN 'unreadable or malformed JSON'
      ELSE 'missing required field ''run''' END AS problem FROM blk WHERE b % 17 = 0 OR b % 19 = 0""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bench_documents(spark, sf_dir).withColumn("file", F.concat(F.lit("run-"), "b"))
    return bench_runs.parse_bench_documents(documents)[1]


@query(
    "b06_validate_runs",
    inputs="bench_samples",
    sql=f"""WITH {_BLOCKS}, arms AS (SELECT * FROM (VALUES ('control_a1'), ('treatment_b'), ('drift_control_a2')) AS t(arm)),
    have AS (SELECT b, arm, count(*) AS n FROM bench_samples GROUP BY ALL)
    SELECT case_id, run, concat(case_id, ' run ', run, ': declared samples != 7') AS problem FROM ok WHERE b % 13 = 0
    UNION ALL SELECT case_id, run, concat(case_id, ' run ', run, ': units must be microseconds') FROM ok WHERE b % 11 = 0
    UNION ALL SELECT case_id, run, concat(case_id, ' run ', run, ': missing arm ', arm) FROM ok, arms WHERE (b, arm) NOT IN (SELECT b, arm FROM have)
    UNION ALL SELECT case_id, run, concat(case_id, ' run ', run, ' ', arm, ': warmups count is 2, expected 3') FROM ok JOIN have USING (b) WHERE b % 9 = 0
    UNION ALL SELECT case_id, run, concat(case_id, ' run ', run, ' ', arm, ': samples count is ', n, ', expected 7') FROM ok JOIN have USING (b) WHERE n <> 7""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.validate_runs(_runs(spark, sf_dir))


@query(
    "b07_run_inventory_check",
    inputs="bench_samples",
    sql=f"""WITH {_BLOCKS}, seen AS (SELECT case_id, run FROM blk UNION ALL SELECT case_id, run FROM blk WHERE b % 41 = 0),
    o AS (SELECT case_id, run, count(*) AS n FROM seen GROUP BY ALL),
    e AS (SELECT case_id, run FROM blk WHERE b % 10 <> 3 UNION SELECT case_id, run + 1000 FROM blk WHERE b % 50 = 0)
    SELECT case_id, run, CASE WHEN e.run IS NOT NULL AND n IS NULL THEN concat(case_id, ': run ', run, ' is missing from the inventory')
      WHEN e.run IS NOT NULL AND n > 1 THEN concat(case_id, ': run ', run, ' appears ', n, ' times')
      WHEN case_id NOT IN (SELECT case_id FROM e) THEN concat('unexpected case ', case_id, ' in the inventory')
      WHEN e.run IS NULL THEN concat(case_id, ': unexpected run ', run, ' in the inventory') END AS problem
    FROM e FULL JOIN o USING (case_id, run) WHERE problem IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = frame(spark, sf_dir, "bench_samples").select("b", "case_id", "run").distinct()
    seen = blocks.unionByName(blocks.where("b % 41 = 0")).drop("b")
    expected = blocks.where("b % 10 <> 3").select("case_id", "run").unionByName(
        blocks.where("b % 50 = 0").selectExpr("case_id", "run + 1000 AS run")
    )
    return measure.run_inventory_check(seen, expected)


@query(
    "b08_provenance_check",
    inputs="bench_samples",
    sql=f"""WITH {_BLOCKS}, p AS (SELECT case_id, run, unnest([
      CASE WHEN b % 7 = 0 THEN 'server version is not the declared one' END, CASE WHEN b % 5 = 0 THEN 'python does not match the declared version' END,
      CASE WHEN b % 23 = 0 THEN 'dataset is not the declared dataset' END, CASE WHEN b % 29 = 0 THEN 'session settings differ from the declared settings' END,
      CASE WHEN case_id = 'case-39' THEN 'no matching entry in the cases' END,
      CASE WHEN case_id <> 'case-39' AND b % 31 = 0 THEN 'measured SQL differs from the case' END,
      CASE WHEN case_id <> 'case-39' AND b % 37 = 0 THEN 'index is not the declared one' END,
      CASE WHEN b % 6 = 0 THEN 'psycopg is not the locked 3.3' END]) AS m FROM ok)
    SELECT case_id, run, concat(case_id, ' run ', run, ': ', m) AS problem FROM p WHERE m IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    declared = measure.Declared(
        "sha256:aa", "17.11", {"psycopg": "3.3"}, "3.13", {"orders": 400000}, ["SET jit = off"]
    )
    cases = (
        frame(spark, sf_dir, "bench_samples")
        .where("case_id <> 'case-39'")
        .select("case_id")
        .distinct()
        .selectExpr(
            "case_id", "'SELECT 1' AS sql", "array('42') AS params", "'ix_a' AS index_name", "'CREATE INDEX ix_a' AS ddl"
        )
    )
    return measure.provenance_check(runs, declared, cases)


@query(
    "b09_session_consistency",
    inputs="bench_samples",
    sql=f"""WITH {_BLOCKS}, f AS (SELECT case_id, 'server' AS field, CAST(b % 7 = 0 AS VARCHAR) AS v FROM ok
      UNION ALL SELECT case_id, 'client', concat(b % 5 = 0, b % 6 = 0) FROM ok
      UNION ALL SELECT case_id, 'session_settings', CAST(b % 29 = 0 AS VARCHAR) FROM ok
      UNION ALL SELECT case_id, 'recorded_at', CAST(b % 3 = 0 AS VARCHAR) FROM ok)
    SELECT case_id, field, count(DISTINCT v) AS distinct_values FROM f GROUP BY ALL HAVING count(DISTINCT v) > 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.session_consistency(_runs(spark, sf_dir), ["case_id"])


define(
    "nplus1_broken",
    """
SELECT o_custkey AS k, count(*) AS orders_returned, 1 + count(*) - CASE WHEN count(*) % 7 = 0 THEN 1 ELSE 0 END AS select_statements,
  concat(min(o_orderkey), ':', max(o_orderkey), ':', CAST(sum(o_orderkey) AS BIGINT)) AS order_ids, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS totals_checksum
FROM {orders} GROUP BY o_custkey
""",
)
define(
    "nplus1_clean",
    """
SELECT o_custkey AS k, count(*) AS orders_returned, 2 + CASE WHEN count(*) % 5 = 0 THEN 1 ELSE 0 END AS select_statements,
  concat(min(o_orderkey), ':', max(o_orderkey), ':', CAST(sum(o_orderkey) AS BIGINT)) AS order_ids, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS totals_checksum
FROM {orders} WHERE o_totalprice < 450000 GROUP BY o_custkey
""",
)


@query(
    "b10_nplus1_evidence",
    inputs="nplus1_broken nplus1_clean",
    sql="""SELECT k, p AS problem FROM (SELECT k, unnest([CASE WHEN c.k IS NULL THEN 'missing entry for the clean side' END,
      CASE WHEN b.orders_returned <> c.orders_returned THEN 'fixtures returned different row counts' END,
      CASE WHEN c.k IS NOT NULL AND b.select_statements <> 1 + b.orders_returned THEN 'broken is not 1+N' END,
      CASE WHEN c.select_statements <> 2 THEN 'clean is not a fixed count of 2' END,
      CASE WHEN b.order_ids <> c.order_ids THEN 'order ids differ between fixtures' END,
      CASE WHEN b.totals_checksum <> c.totals_checksum THEN 'totals checksums differ between fixtures' END]) AS p
    FROM nplus1_broken b LEFT JOIN nplus1_clean c USING (k)) x WHERE p IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.nplus1_evidence(
        frame(spark, sf_dir, "nplus1_broken"), frame(spark, sf_dir, "nplus1_clean"), "k"
    )


def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan document per order: a join over one to five scans."""
    key = F.col("o_orderkey")

    def scan(i):
        indexed = (key + i) % 3 == 0
        return F.struct(
            F.when(indexed, "Index Scan").otherwise("Seq Scan").alias("Node Type"),
            F.concat(F.lit("part_"), (key + i) % 5).alias("Relation Name"),
            F.when(indexed, F.concat(F.lit("ix_"), (key + i) % 4)).alias("Index Name"),
            F.when(indexed, "Forward").alias("Scan Direction"),
            (i * 10).alias("Plan Rows"),
        )

    scans = F.transform(F.sequence(F.lit(1).cast("long"), key % 5 + 1), scan)
    join = F.struct(F.lit("Hash Join").alias("Node Type"), F.lit("Inner").alias("Join Type"), scans.alias("Plans"))
    sort = F.struct(
        F.lit("Sort").alias("Node Type"), F.array(F.lit("created_at DESC")).alias("Sort Key"), F.array(join).alias("Plans")
    )
    root = F.struct(
        F.lit("Aggregate").alias("Node Type"), F.lit("Hashed").alias("Strategy"), F.lit(7).alias("WAL Records"), F.array(sort).alias("Plans")
    )
    keys = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    return keys.select("o_orderkey", F.to_json(F.array(F.struct(root.alias("Plan")))).alias("doc"))


_SCANS = """n AS (SELECT o_orderkey, i, CAST(i * 10 AS DOUBLE) AS plan_rows, concat('part_', (o_orderkey + i) % 5) AS rel, CASE WHEN (o_orderkey + i) % 3 = 0 THEN concat('ix_', (o_orderkey + i) % 4) END AS ix
    FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 5 + 2)) AS i FROM orders) x)"""


@query(
    "b11_flatten_plans",
    sql=f"""WITH {_SCANS}, o AS (SELECT o_orderkey FROM orders)
    SELECT o_orderkey, 0 AS node, NULL AS parent, 0 AS depth, 'Aggregate' AS node_type, 'Hashed' AS strategy, NULL AS relation_name, NULL AS index_name, NULL AS join_type, '[]' AS sort_key, NULL AS plan_rows, 7 AS wal_records, 0 AS wal_bytes FROM o
    UNION ALL SELECT o_orderkey, 1, 0, 1, 'Sort', NULL, NULL, NULL, NULL, '["created_at DESC"]', NULL, NULL, NULL FROM o
    UNION ALL SELECT o_orderkey, 2, 1, 2, 'Hash Join', NULL, NULL, NULL, 'Inner', '[]', NULL, NULL, NULL FROM o
    UNION ALL SELECT o_orderkey, 2 + i, 2, 3, CASE WHEN ix IS NULL THEN 'Seq Scan' ELSE 'Index Scan' END, NULL, rel, ix, NULL, '[]', plan_rows, NULL, NULL FROM n""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_trees.flatten_plans(plan_documents(spark, sf_dir), ["o_orderkey"]).select(
        "o_orderkey", "node", "parent", "depth", "node_type", "strategy", "relation_name", "index_name", "join_type",
        "sort_key", "plan_rows", "wal_records", "wal_bytes",
    )


def _node_json(kind: str, children: str, join: str = "null", strategy: str = "null", sort: str = "[]") -> str:
    head = '{"children":['
    tail = (
        f'],"group_key":[],"index_name":null,"join_type":{join},"node_type":"{kind}","relation_name":null,'
        f'"scan_direction":null,"sort_key":{sort},"strategy":{strategy}}}'
    )
    return f"concat('{head}', {children}, '{tail}')"


@query(
    "b13_plan_fingerprint",
    sql=f"""WITH {_SCANS}, j AS (SELECT o_orderkey, string_agg(concat('{{"children":[],"group_key":[],"index_name":', CASE WHEN ix IS NULL THEN 'null' ELSE concat('"', ix, '"') END,
      ',"join_type":null,"node_type":"', CASE WHEN ix IS NULL THEN 'Seq Scan' ELSE 'Index Scan' END, '","relation_name":"', rel, '","scan_direction":',
      CASE WHEN ix IS NULL THEN 'null' ELSE '"Forward"' END, ',"sort_key":[],"strategy":null}}'), ',' ORDER BY i) AS s FROM n GROUP BY 1)
    SELECT o_orderkey, concat('sha256:', sha256({_node_json("Aggregate", _node_json("Sort", _node_json("Hash Join", "s", join='"Inner"'), sort='["created_at DESC"]'), strategy='"Hashed"')})) AS plan_fingerprint FROM j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_trees.plan_fingerprints(plan_documents(spark, sf_dir), ["o_orderkey"])


@query(
    "b14_plan_shape",
    sql=f"""WITH {_SCANS} SELECT o_orderkey, concat('Aggregate (Hashed) -> (Sort -> (Inner Hash Join -> (',
      string_agg(CASE WHEN ix IS NULL THEN concat('Seq Scan on ', rel) ELSE concat('Index Scan using ', ix) END, ', ' ORDER BY i), ')))') AS normalized_shape
    FROM n GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_trees.plan_shapes(plan_documents(spark, sf_dir), ["o_orderkey"])


define(
    "write_measurements",
    """
SELECT concat(case_id, '#', run) AS candidate, CASE arm WHEN 'control_a1' THEN 'insert' WHEN 'treatment_b' THEN 'update_indexed_column'
  ELSE 'update_unrelated_column' END AS operation, CASE WHEN idx % 2 = 0 THEN 'before' ELSE 'after' END AS phase,
  value_us AS execution_us, CASE WHEN value_us % 4 > 0 THEN value_us * 3 END AS wal_bytes
FROM {bench_samples}
""",
)
_WRITE = """w AS (SELECT candidate, operation, max(execution_us) FILTER (WHERE phase = 'before') AS eb, max(execution_us) FILTER (WHERE phase = 'after') AS ea,
      max(wal_bytes) FILTER (WHERE phase = 'before') AS wb, max(wal_bytes) FILTER (WHERE phase = 'after') AS wa FROM write_measurements GROUP BY ALL)"""


@query(
    "b12_write_cost_delta",
    inputs="write_measurements",
    sql=f"""WITH {_WRITE}, bd AS (SELECT concat(case_id, '#', run) AS candidate, max(value_us) AS build_us, CAST(sum(value_us) AS BIGINT) * 8 AS index_size_bytes FROM bench_samples WHERE kind = 'sample' GROUP BY 1)
    SELECT w.candidate, operation, eb AS execution_us_before, ea AS execution_us_after, ea - eb AS execution_us_delta,
      wb AS wal_bytes_before, wa AS wal_bytes_after, wa - wb AS wal_bytes_delta, build_us, index_size_bytes FROM w LEFT JOIN bd USING (candidate)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = (
        frame(spark, sf_dir, "bench_samples")
        .where("kind = 'sample'")
        .groupBy(F.concat_ws("#", "case_id", F.col("run").cast("string")).alias("candidate"))
        .agg(F.max("value_us").alias("build_us"), (F.sum("value_us") * 8).alias("index_size_bytes"))
    )
    return measure.write_cost_delta(frame(spark, sf_dir, "write_measurements"), builds)


@query(
    "t08_verified_candidates",
    inputs="bench_samples write_measurements",
    sql=f"""WITH {_STATS}, {_VERDICT}, {_WRITE} SELECT candidate, operation, round(ratio, 6) AS ratio, inconclusive,
      NOT inconclusive AND coalesce(ratio >= 1.2, false) AS read_benefit_verified, ea - eb AS execution_us_delta
    FROM (SELECT *, concat(case_id, '#', run) AS candidate FROM ve) x JOIN w USING (candidate)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = measure.experiment_verdict(_statistics(spark, sf_dir)).select(
        F.concat_ws("#", "case_id", F.col("run").cast("string")).alias("candidate"), "inconclusive", "ratio"
    )
    costs = measure.write_cost_delta(frame(spark, sf_dir, "write_measurements"))
    return _rounded(measure.verified_candidates(verdicts, costs), "ratio").select(
        "candidate", "operation", "ratio", "inconclusive", "read_benefit_verified", "execution_us_delta"
    )


define(
    "recorded_proofs",
    """
SELECT concat(case_id, '#', run) AS proof_id, CASE WHEN b % 6 > 0 THEN max(CASE WHEN arm = 'control_a1' THEN value_us END) END AS control_us,
  min(CASE WHEN arm <> 'control_a1' THEN value_us END) AS treatment_us, CASE WHEN b % 4 > 0 THEN concat('fp', b % 2) END AS plan_fingerprint
FROM {bench_samples} GROUP BY b, case_id, run
""",
)
define(
    "renewed_proofs",
    """
SELECT concat(case_id, '#', run) AS proof_id, CASE WHEN b % 5 = 0 THEN 0.9 WHEN b % 9 > 0 THEN 1.5 END AS ratio,
  max(value_us) > 4500 AS inconclusive, CASE WHEN b % 10 > 0 THEN concat('fp', b % 3) END AS new_plan_fingerprint
FROM {bench_samples} GROUP BY b, case_id, run
""",
)


@query(
    "b15_reproduction_verdict",
    inputs="recorded_proofs renewed_proofs",
    sql="""WITH j AS (SELECT *, (control_us / treatment_us > 1.0) = coalesce(ratio > 1.0, false) AS direction_matches,
      plan_fingerprint = new_plan_fingerprint AS plan_shape_compatible, NOT inconclusive AS stable FROM recorded_proofs JOIN renewed_proofs USING (proof_id))
    SELECT proof_id, direction_matches, plan_shape_compatible, stable, coalesce(direction_matches, false) AND stable AND coalesce(plan_shape_compatible, true) AS reproduced FROM j""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.reproduction_verdict(
        frame(spark, sf_dir, "recorded_proofs"), frame(spark, sf_dir, "renewed_proofs")
    )
    return found.select("proof_id", "direction_matches", "plan_shape_compatible", "stable", "reproduced")


define(
    "proof_rows",
    """
SELECT concat(CASE WHEN o_orderkey % 9 = 0 THEN 'OTHER-001' ELSE concat('IDX-', lpad(CAST(o_custkey AS STRING), 6, '0')) END, '@', o_orderkey) AS id,
  concat('IDX-', lpad(CAST(o_custkey AS STRING), 6, '0')) AS recommendation,
  CASE o_orderstatus WHEN 'F' THEN 'verified_in_fixture' WHEN 'O' THEN 'rejected' ELSE 'inconclusive' END AS verdict,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'control_a1' WHEN '2' THEN 'control_a1,treatment_b' ELSE 'control_a1,treatment_b,drift_control_a2' END AS arms,
  CASE WHEN o_totalprice > 100000 THEN CAST(round(o_totalprice) AS BIGINT) END AS absolute_saving_us,
  CASE WHEN o_totalprice > 150000 THEN 'too small' END AS rejection_reason, CASE WHEN o_totalprice < 300000 THEN 'noisy' END AS stability_note
FROM {orders}
""",
)


@query(
    "b16_proof_summary_check",
    inputs="proof_rows",
    sql="""SELECT id, p AS problem FROM (SELECT id, unnest([
      CASE WHEN verdict = 'verified_in_fixture' AND arms = 'control_a1' THEN 'verified_in_fixture requires control, treatment and drift arms; missing drift_control_a2, treatment_b'
        WHEN verdict = 'verified_in_fixture' AND arms = 'control_a1,treatment_b' THEN 'verified_in_fixture requires control, treatment and drift arms; missing drift_control_a2' END,
      CASE WHEN verdict = 'verified_in_fixture' AND absolute_saving_us IS NULL THEN 'verified_in_fixture requires an absolute saving' END,
      CASE WHEN verdict = 'rejected' AND rejection_reason IS NULL THEN 'a rejected candidate must state why' END,
      CASE WHEN verdict = 'inconclusive' AND stability_note IS NULL THEN 'an inconclusive result must state its instability' END,
      CASE WHEN NOT starts_with(id, concat(recommendation, '@')) THEN 'proof id must be its recommendation plus the input-manifest hash' END]) AS p FROM proof_rows) x WHERE p IS NOT NULL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = frame(spark, sf_dir, "proof_rows").withColumn("arms", F.split("arms", ","))
    return measure.proof_summary_check(proofs)


@query(
    "b17_summary_drift",
    inputs="nplus1_broken nplus1_clean",
    sql="""WITH a AS (SELECT k, orders_returned, totals_checksum FROM nplus1_broken), b AS (SELECT k, orders_returned, totals_checksum FROM nplus1_clean)
    SELECT *, 'stored' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x UNION ALL SELECT *, 'computed' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["k", "orders_returned", "totals_checksum"]
    return measure.drift_both_ways(
        frame(spark, sf_dir, "nplus1_broken").select(*columns), frame(spark, sf_dir, "nplus1_clean")
    )


@query(
    "b18_parameters_available",
    inputs="capture",
    sql="""SELECT sequence, query_id = 'view' AND rowcount % 7 > 0 AND bind IS NOT NULL AS available FROM capture""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = """array(struct(query_id <> 'view' AS is_redacted, 'x' AS redacted_value),
      struct(IF(rowcount % 7 = 0, NULL, false) AS is_redacted, bind AS redacted_value))"""
    log = frame(spark, sf_dir, "capture").select("sequence", F.expr(parameters).alias("parameters"))
    return measure.parameters_available(log).select("sequence", "available")
