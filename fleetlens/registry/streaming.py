"""Streaming queries over event files derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.identity import rfc3339
from fleetlens.operators.workload import OPERATION
from fleetlens.registry.base import query
from fleetlens.registry.inputs import frame, table
from fleetlens.registry.quality import TRANSITIONS_SQL, stage_log
from fleetlens.registry.workload import _GOOD, AMPLIFICATION_SQL, capture_lines
from fleetlens.sources.scratch import new_path
from fleetlens.streaming import load, sinks, stages, workload

_CHUNKS = 3
_FILE_ROWS = 50_000


def _arriving(df: DataFrame, order: Column | str, label: str, form: str) -> tuple[str, int]:
    """Write `df` in a few steps by `order`, the way files arrive in an append-only folder.

    Returns the folder and how many files a batch takes. A large step has that many files, all with
    rows, so that no batch holds a part of a step; rows without `order` come first.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    low, high = df.agg(F.min(order), F.max(order)).first()
    low = 0 if low is None else low
    wide = (0 if high is None else high) + 1 - low
    at = F.coalesce(order, F.lit(low)) - F.lit(low)
    step = sum(((at >= wide * n // _CHUNKS).cast("int") for n in range(1, _CHUNKS)), F.lit(0))
    rows = {r["step"]: r["count"] for r in df.groupBy(step.alias("step")).count().collect()}
    least = min(rows.values(), default=0)
    files = 1 if least < _FILE_ROWS // 5 else min(spark.sparkContext.defaultParallelism, max(2, least // _FILE_ROWS))
    for n in sorted(rows) or [0]:
        df.where(step == n).repartition(files).write.mode("append").format(form).save(path)
    return path, max(2, files)


def _event_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    log = frame(spark, sf_dir, "capture").select(
        *OPERATION,
        "sequence",
        "duration_us",
        "query_id",
        "statement_class",
        "rowcount",
        "bind",
        F.col("ts").cast("timestamp").alias("at"),
    )
    # Events of copied logs may have times that do not follow the sequence; files come as time goes on.
    return _arriving(log, F.unix_micros("at"), "event-files", "json")


@query(
    "l01_stage_event_source",
    inputs="stage_events",
    sql="SELECT run_id, stage, status, pos, strftime(at_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, detail FROM stage_events",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = _arriving(_stage_rows(spark, sf_dir), "pos", "stage-files", "json")
    return sinks.drain(stages.stage_stream(spark, path, files), "stage-events")


def _stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_log(spark, sf_dir).withColumn("at", rfc3339("at"))


@query(
    "l02_stream_operation_rollup",
    inputs="capture",
    sql="""SELECT app_id, run_id, node_id, phase, query_id, count(*) AS executions, CAST(sum(duration_us) AS BIGINT) AS duration_us FROM capture GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workload.event_stream(spark, *_event_files(spark, sf_dir))
    sinks.use_rocksdb(events)
    updates = sinks.drain(workload.operation_rollup(events), "rollup", updates=True)
    return sinks.latest(updates, [*OPERATION, "query_id"])


@query("l03_stream_amplification", inputs="capture", sql=AMPLIFICATION_SQL.replace("{extra}", ""))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = _event_files(spark, sf_dir)
    # A row of no operation, long after all others, as a log's last line: it closes what is open.
    last = frame(spark, sf_dir, "capture").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 100 DAYS")).alias("at"))
    last.write.mode("append").json(path)
    events = workload.event_stream(spark, path, files)
    sinks.use_rocksdb(events)
    return sinks.drain(workload.amplification(events, gap="40 DAYS", width=1024), "amplifications")


@query("l04_stream_stage_state", inputs="stage_events", sql=TRANSITIONS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = _arriving(_stage_rows(spark, sf_dir), "pos", "stage-files", "json")
    events = stages.stage_stream(spark, path, files)
    sinks.use_rocksdb(events)
    return sinks.drain(stages.stage_moves(events), "stage-moves").drop("started_at", "late")


@query(
    "l05_stream_quarantine",
    inputs="capture",
    sql=f"SELECT 'event' AS kind, count(*) AS lines FROM capture WHERE {_GOOD} UNION ALL SELECT 'bad line', count(*) FROM capture WHERE rowcount % 23 <> 0 AND NOT ({_GOOD})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "capture-lines")
    capture_lines(spark, sf_dir).repartition(6).write.text(path)
    events, bad = new_path(spark, "events"), new_path(spark, "bad-lines")
    lines = stages.line_stream(spark, path, 2)
    stages.start_quarantine(lines, events, bad, new_path(spark, "quarantine-checkpoint")).awaitTermination()
    good = spark.read.parquet(events).agg(F.count("*").alias("lines"))
    kept = spark.read.parquet(bad).agg(F.count("*").alias("lines"))
    return good.select(F.lit("event").alias("kind"), "lines").unionByName(
        kept.select(F.lit("bad line").alias("kind"), "lines")
    )


_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"
_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value"
    )
    path, files = _arriving(events, "event_id", "event-tables", "parquet")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def _printed(df: DataFrame) -> DataFrame:
    shape = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return df.withColumn("starts", F.date_format("starts", shape)).withColumn(
        "ends", F.date_format("ends", shape)
    )


@query(
    "l06_stream_tumbling_load",
    sql=f"""SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '{_STAMP}') AS starts, strftime(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR, '{_STAMP}') AS ends, event_type, count(*) AS events, round(sum(value), 4) AS load
    FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir)
    return _printed(sinks.drain(load.windowed_load(events, "6 hours"), "tumbling"))


@query(
    "l06_stream_sliding_load",
    sql=f"""WITH w AS (SELECT e.*, time_bucket(INTERVAL 2 HOUR, ts) - to_hours(2 * k) AS s FROM events e, range(0, 3) r(k))
    SELECT strftime(s, '{_STAMP}') AS starts, strftime(s + INTERVAL 6 HOUR, '{_STAMP}') AS ends, event_type, count(*) AS events, round(sum(value), 4) AS load FROM w WHERE s + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir)
    return _printed(sinks.drain(load.windowed_load(events, "6 hours", "2 hours"), "sliding"))


@query(
    "l06_stream_session_load",
    sql=f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g),
    x AS (SELECT user_id, n, min(ts) AS a, max(ts) + INTERVAL 5 HOUR AS z, count(*) AS events FROM s GROUP BY ALL)
    SELECT strftime(a, '{_STAMP}') AS starts, strftime(z, '{_STAMP}') AS ends, user_id, events FROM x WHERE z <= {_CLOSED}""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir)
    return _printed(sinks.drain(load.session_load(events, "5 hours", "user_id"), "sessions"))
