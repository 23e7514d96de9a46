"""Operations, transactions and amplification from the captured query log.

An operation is one (app, run, test node, phase). All rollups start from one pre-aggregation
by (operation, query), so a hot operation is combined before its rows are shuffled. What a
query is (class, relations, text) comes from `queries`, one row per query id.

Events are in order of `sequence`, then of `arrival` (the place of the line in the log, any type
with an order) where the events have that column, then of the query id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.identity import sha256_text
from fleetlens.plans.ordering import SEQUENCE_WIDTH, position_by_sequence
from fleetlens.sources.scratch import materialize

RUN = ["app_id", "run_id"]
OPERATION = [*RUN, "node_id", "phase"]
MIN_REPETITIONS = 5


def _ties(events: DataFrame) -> list[str]:
    """The columns that order events of equal sequence."""
    return [*[c for c in events.columns if c == "arrival"], "query_id"]


def executions_by_query(events: DataFrame) -> DataFrame:
    """One row per (operation, query): executions, duration and first sequence number.

    Only numbers are aggregated, so this stays a generated hash aggregation.
    """
    return events.groupBy(*OPERATION, "query_id").agg(
        F.count("*").alias("executions"),
        F.sum("duration_us").alias("duration_us"),
        F.min("sequence").alias("first_sequence"),
    )


def query_catalog(events: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per (run, query) with its call sites in first-seen order, without repeats.

    `queries` holds query_id, statement_class, normalized_sql and parse_error. Sites are
    reduced to distinct code places before they are listed.
    """
    counts = events.groupBy(*RUN, "query_id").agg(F.count("*").alias("executions"))
    arrival = _ties(events)[:-1]
    sites = (
        events.select(*RUN, "query_id", "sequence", *arrival, F.posexplode("call_sites").alias("at", "site"))
        .groupBy(*RUN, "query_id", "site")
        .agg(F.min(F.struct("sequence", *arrival, "at")).alias("seen"))
        .groupBy(*RUN, "query_id")
        .agg(F.array_sort(F.collect_list(F.struct("seen", "site"))).alias("_sites"))
    )
    facts = queries.select("query_id", "statement_class", "normalized_sql", "parse_error")
    return (
        counts.join(facts, "query_id")
        .join(sites, [*RUN, "query_id"], "left")
        .withColumn("call_sites", F.coalesce("_sites.site", F.array()))
        .drop("_sites")
    )


def _tables(statement_class: str) -> Column:
    lists = F.collect_set(F.when(F.col("statement_class") == statement_class, F.col("relations")))
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def operation_rollup(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Tables read and written, duration (0 becomes null) and entry point of each operation.

    `queries` holds query_id, statement_class and relations. Events are combined by (operation,
    query) before anything about the query is looked up; the entry point is the first call
    site of the first event that has one.
    """
    rolled = (
        executions_by_query(events)
        .join(queries.select("query_id", "statement_class", "relations"), "query_id", "left")
        .groupBy(*OPERATION)
        .agg(
            F.sum("executions").alias("query_count"),
            _tables("read").alias("tables_read"),
            _tables("write").alias("tables_written"),
            F.nullif(F.sum("duration_us"), F.lit(0).cast("long")).alias("observed_duration_us"),
            F.min("first_sequence").alias("first_sequence"),
        )
    )
    entries = (
        events.where(F.size("call_sites") > 0)
        .groupBy(*OPERATION)
        .agg(
            F.min_by(F.get("call_sites", F.lit(0)), F.struct("sequence", *_ties(events))).alias("entry_point")
        )
    )
    return rolled.join(entries, OPERATION, "left")


def operation_query_counts(events: DataFrame) -> DataFrame:
    """Executions of each query inside an operation, every class counted."""
    return events.groupBy(*OPERATION, "query_id").agg(F.count("*").alias("executions"))


def transaction_rollup(
    events: DataFrame, outcomes: DataFrame, width: int = SEQUENCE_WIDTH
) -> DataFrame:
    """Queries of each transaction inside an operation, one row per position.

    `outcomes` holds (app_id, run_id, transaction_id, committed); a transaction it lacks
    counts as not committed. Events outside a transaction are left out.
    """
    inside = events.where("transaction_id IS NOT NULL").select(
        *OPERATION, "transaction_id", "sequence", *_ties(events)
    )
    placed = position_by_sequence(
        inside, [*OPERATION, "transaction_id"], "sequence", "position", width, _ties(events)
    ).drop("arrival")
    known = outcomes.select(*RUN, "transaction_id", "committed")
    return placed.join(known, [*RUN, "transaction_id"], "left").withColumn(
        "committed", F.coalesce("committed", F.lit(False))
    )


def amplification_class(executions: Column, same_binds: Column, parent: Column) -> Column:
    return (
        F.when(same_binds, "repeated_query")
        .when(
            (parent["statement_class"] == "read") & (parent["rowcount"] == executions),
            "observed_n_plus_one",
        )
        .otherwise("possible_amplification")
    )


def _bind_marks(signature: Column) -> list[Column]:
    """Two independent 64-bit marks of a bind signature; equal binds have equal marks.

    The JSON form is marked, because hashing an array passes over its nulls.
    """
    text = F.to_json(signature)
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def detect_amplification(
    events: DataFrame, min_repetitions: int = MIN_REPETITIONS, width: int = SEQUENCE_WIDTH
) -> DataFrame:
    """Queries repeated inside an operation, with the query that ran right before them.

    Nothing before a first occurrence can be the same query, so the nearest earlier distinct
    query is the previous event. First the repeated queries are found by one numeric
    aggregation that combines before the shuffle (equal binds are seen by min = max). Only
    events near their first occurrences are then put in order: operations are cut into pieces
    of `width` sequence numbers, so a hot operation never meets in one task, and a first
    occurrence that opens its piece looks at the end of the piece before.
    """
    ties = _ties(events)
    first_mark, second_mark = _bind_marks(F.col("bind_signature"))
    piece = F.floor(F.col("sequence") / width).alias("piece")
    marked = events.select(
        *OPERATION, "query_id", "sequence", first_mark.alias("m1"), second_mark.alias("m2")
    )
    same = (F.min("m1") == F.max("m1")) & (F.min("m2") == F.max("m2"))
    repeated = materialize(
        marked.groupBy(*OPERATION, "query_id")
        .agg(
            F.count("*").alias("repetitions"),
            F.min("sequence").alias("sequence"),
            same.alias("same_binds"),
        )
        .where(F.col("repetitions") >= min_repetitions)
        .withColumn("piece", F.floor(F.col("sequence") / width)),
        "repeated",
    )
    slim = events.select(
        *OPERATION, piece, "sequence", *ties, F.struct("query_id", "statement_class", "rowcount").alias("record")
    )
    order = Window.partitionBy(*OPERATION, "piece").orderBy("sequence", *ties)
    nth = Window.partitionBy(*OPERATION, "piece", "query_id").orderBy("sequence", *ties)
    # A first occurrence is in the piece of the least sequence number of its query.
    ordered = (
        slim.join(repeated.select(*OPERATION, "piece").distinct(), [*OPERATION, "piece"], "left_semi")
        .withColumn("near", F.lag("record").over(order))
        .withColumn("nth", F.row_number().over(nth))
        .where("nth = 1")
        .select(*OPERATION, "piece", "query_id", "near")
    )
    found = materialize(
        repeated.join(ordered, [*OPERATION, "piece", "query_id"]), "first-occurrences"
    )
    openers = found.where("near IS NULL AND piece > 0").select(*OPERATION).distinct()
    if openers.isEmpty():
        parents = found.withColumnRenamed("near", "parent")
    else:
        edges = (
            slim.join(openers, OPERATION, "left_semi")
            .groupBy(*OPERATION, "piece")
            .agg(F.max_by("record", F.struct("sequence", *ties)).alias("last"))
            .withColumn("far", F.lag("last").over(Window.partitionBy(*OPERATION).orderBy("piece")))
            .drop("last")
        )
        parents = found.join(edges, [*OPERATION, "piece"], "left").withColumn(
            "parent", F.coalesce("near", "far")
        )
    return parents.where("parent IS NOT NULL").select(
        *OPERATION,
        F.col("parent.query_id").alias("parent_query"),
        F.col("query_id").alias("child_query"),
        "repetitions",
        amplification_class(
            F.col("repetitions"), F.col("same_binds"), F.col("parent")
        ).alias("classification"),
        F.col("sequence").alias("first_sequence"),
    )


def amplification_call_sites(amplifications: DataFrame, events: DataFrame) -> DataFrame:
    """Add `call_site`, the first call site of the first repeated event itself."""
    child = [*OPERATION, "child_query"]
    firsts = events.withColumnsRenamed({"query_id": "child_query", "sequence": "first_sequence"}).join(
        amplifications.select(*child, "first_sequence"), [*child, "first_sequence"], "left_semi"
    )
    # The struct keeps an event without any site in its place.
    site = F.struct(F.get("call_sites", F.lit(0)).alias("call_site"))
    place = F.struct(*[c for c in ("arrival",) if c in events.columns], "first_sequence")
    sites = firsts.groupBy(*child).agg(F.min_by(site, place).alias("_first"))
    return (
        amplifications.join(sites, child)
        .withColumn("call_site", F.col("_first.call_site"))
        .drop("_first")
    )


def name_relationships(
    amplifications: DataFrame, queries: DataFrame, foreign_keys: DataFrame
) -> DataFrame:
    """Add `relationship_name`: the only foreign key from the child's only table to the parent's.

    `queries` holds query_id and relations, `foreign_keys` name, table_id, referenced_table.
    """
    only = foreign_keys.groupBy("table_id", "referenced_table").agg(
        F.when(F.count("*") == 1, F.min("name")).alias("relationship_name")
    )
    single = queries.select(
        "query_id", F.when(F.size("relations") == 1, F.get("relations", F.lit(0))).alias("relation")
    )

    def side(query: str, relation: str) -> DataFrame:
        return single.select(F.col("query_id").alias(query), F.col("relation").alias(relation))

    return (
        amplifications.join(side("child_query", "table_id"), "child_query", "left")
        .join(side("parent_query", "referenced_table"), "parent_query", "left")
        .join(only, ["table_id", "referenced_table"], "left")
        .drop("table_id", "referenced_table")
    )


def capture_coverage(runs: DataFrame) -> DataFrame:
    """Coverage and note of each run from exit code, event count and malformed line count."""
    failed = F.col("exit_code") != 0
    broken = F.col("malformed_lines") > 0
    return runs.withColumn(
        "coverage", F.when(failed | broken, "partial").otherwise("complete_for_selection")
    ).withColumn(
        "boundary_note",
        F.when(
            failed,
            F.format_string(
                "test command exited %d; %d query event(s) captured before it stopped",
                F.col("exit_code"),
                F.col("event_count"),
            ),
        )
        .when(
            broken, F.format_string("%d capture line(s) failed to parse", F.col("malformed_lines"))
        )
        .otherwise("capture completed for the selected test command"),
    )


def describe_bind_values(events: DataFrame, reveal: bool = False) -> DataFrame:
    """Replace `bind_rows` by `parameters`: shape and hash, the value only when revealed.

    A batch is described by its first row.
    """
    first = F.coalesce(F.get("bind_rows", F.lit(0)), F.array())
    described = F.transform(
        first,
        lambda bind: F.struct(
            bind["position"].alias("position"),
            bind["python_type"].alias("python_type"),
            sha256_text(bind["value"]).alias("value_hash"),
            F.lit(not reveal).alias("is_redacted"),
            (bind["value"] if reveal else F.lit(None).cast("string")).alias("redacted_value"),
        ),
    )
    return events.withColumn("parameters", described).drop("bind_rows")


def test_outcomes(reports: DataFrame) -> DataFrame:
    """Final outcome of each test: its last call outcome, else failed when its setup failed."""
    return (
        reports.groupBy(*RUN, "node_id")
        .agg(
            F.expr("max_by(outcome, pos) FILTER (WHERE stage = 'call')").alias("_call"),
            F.bool_or((F.col("stage") == "setup") & (F.col("outcome") == "failed")).alias("_setup"),
        )
        .withColumn("outcome", F.coalesce("_call", F.when(F.col("_setup"), "failed")))
        .where("outcome IS NOT NULL")
        .drop("_call", "_setup")
    )


def test_totals(reports: DataFrame) -> DataFrame:
    """Selected, passed and failed tests of each run."""
    return (
        test_outcomes(reports)
        .groupBy(*RUN)
        .agg(
            F.count("*").alias("selected_tests"),
            F.count_if(F.col("outcome") == "passed").alias("passed_tests"),
            F.count_if(F.col("outcome") == "failed").alias("failed_tests"),
        )
    )
