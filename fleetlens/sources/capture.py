"""Capture logs: newline-delimited JSON query events and per-run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.identity import SHA256_PATTERN, is_repository_path

PHASES = ["setup", "call", "teardown"]
_BAD = "_bad"

SITE = "struct<path:string,line:int,end_line:int,content_hash:string,symbol:string>"
EVENT_SCHEMA = (
    "app_id string, run_id string, sequence bigint, duration_us bigint, statement string, "
    "dialect string, parameters array<struct<position:string,python_type:string,"
    "value_hash:string,is_redacted:boolean,redacted_value:string>>, executemany boolean, "
    "batch_size bigint, rowcount bigint, transaction_id string, node_id string, phase string, "
    f"call_sites array<{SITE}>, error_class string, process_id bigint, thread_id bigint, "
    "task_id string"
)
SUMMARY_SCHEMA = (
    "selected_tests bigint, passed_tests bigint, failed_tests bigint, "
    "transaction_outcomes map<string,boolean>"
)


def _valid(event: Column) -> Column:
    """Field rules of one captured event; null counts as invalid."""
    parameters = F.coalesce(event["parameters"], F.array())
    sites = F.coalesce(event["call_sites"], F.array())

    def not_empty(text: Column) -> Column:
        return F.coalesce(F.length(text) > 0, F.lit(True))

    def line_number(line: Column) -> Column:
        return F.coalesce(line >= 1, F.lit(True))

    rules = (
        event["sequence"].isNotNull()
        & (event["duration_us"] >= 0)
        & (F.length(event["statement"]) > 0)
        & (F.length(event["dialect"]) > 0)
        & (F.length(event["node_id"]) > 0)
        & event["phase"].isin(PHASES)
        & event["process_id"].isNotNull()
        & event["thread_id"].isNotNull()
        & not_empty(event["transaction_id"])
        & not_empty(event["error_class"])
        & not_empty(event["task_id"])
        & F.forall(
            parameters,
            lambda p: (F.length(p["python_type"]) > 0)
            & (F.length(p["position"]) > 0)
            & F.coalesce(p["value_hash"].rlike(SHA256_PATTERN), F.lit(True))
            & not_empty(p["redacted_value"]),
        )
        & F.forall(
            sites,
            lambda s: is_repository_path(s["path"])
            & s["content_hash"].rlike(SHA256_PATTERN)
            & line_number(s["line"])
            & line_number(s["end_line"])
            & not_empty(s["symbol"]),
        )
    )
    return F.coalesce(rules, F.lit(False))


def parse_capture_lines(lines: DataFrame) -> DataFrame:
    """`lines` (value) to (value, event, is_valid); blank lines are dropped, bad lines kept."""
    parsed = F.from_json(
        "value",
        f"{EVENT_SCHEMA}, {_BAD} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD},
    )
    return (
        # No-break and other wide blanks count as blank too.
        lines.where(F.col("value").rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))
        .withColumn("event", parsed)
        .withColumn("is_valid", F.col(f"event.{_BAD}").isNull() & _valid(F.col("event")))
        .withColumn("event", F.col("event").dropFields(_BAD))
    )


def read_capture_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, malformed): valid events, and the count of bad lines per file.

    `arrival` is the place of an event's line: file, start of the piece of the file that a task
    reads, and a number that grows along that piece. It orders events of equal sequence.
    """
    lines = spark.read.text(path).select(
        "value",
        F.input_file_name().alias("file"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("arrival"),
    )
    parsed = parse_capture_lines(lines)
    events = parsed.where("is_valid").select("event.*", "arrival")
    malformed = parsed.groupBy("file").agg(F.count_if(~F.col("is_valid")).alias("malformed_lines"))
    return events, malformed


def parse_capture_summaries(runs: DataFrame) -> DataFrame:
    """Totals of each run from its summary text; missing or broken text gives zeros."""
    parsed = F.from_json("summary", f"{SUMMARY_SCHEMA}, {_BAD} string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD,
    })
    usable = F.col(f"_parsed.{_BAD}").isNull()
    zero = F.lit(0).cast("long")

    def total(name: str) -> Column:
        return F.coalesce(F.when(usable, F.col(f"_parsed.{name}")), zero).alias(name)

    return runs.withColumn("_parsed", parsed).select(
        *[c for c in runs.columns if c != "summary"],
        total("selected_tests"),
        total("passed_tests"),
        total("failed_tests"),
        F.coalesce(
            F.when(usable, F.col("_parsed.transaction_outcomes")),
            F.create_map().cast("map<string,boolean>"),
        ).alias("transaction_outcomes"),
    )


def read_capture_summaries(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """Join each (app_id, run_id) with its one-line summary document, then parse it."""
    documents = spark.read.schema("app_id string, run_id string, summary string").json(path)
    return parse_capture_summaries(runs.join(documents, ["app_id", "run_id"], "left"))
