"""Realized selectivity of predicates, measured on the tables themselves.

Every count comes from the data. A table is reduced to value frequencies first (combined
before the shuffle); tiers, cutoffs and re-counts are then read from the frequencies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.identity import sha256_text
from fleetlens.plans.ordering import running_total

# The two windows in days; the three cutoff fractions.
RECENT_DAYS = 7
MONTHLY_DAYS = 30
FRACTIONS = {"low": 0.1, "mid": 0.5, "high": 0.9}


@dataclass(frozen=True)
class Predicate:
    """One probeable comparison. Predicates are catalog-sized metadata, never data rows."""

    table_id: str
    column: str
    parameter_position: int
    operator: str
    kind: str


def table_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table, rows with nulls included."""
    counts = [
        df.agg(F.count("*").alias("total_row_count")).select(
            F.lit(name).alias("table_id"), "total_row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def frequencies(df: DataFrame, columns: Sequence[str], value_type: str) -> DataFrame:
    """(column, value, n) of the non-null values of several columns, from one scan."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast(value_type).alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def _spread(freq: DataFrame) -> DataFrame:
    """(column, distinct_values, rare, common, median_count): one row per profiled column."""
    return freq.groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        F.min(F.struct("n", "value")).alias("rare"),
        F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("common"),
        # Counted from the top, the middle of an even number is the upper one.
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").cast("long").alias("median_count"),
    )


def equality_probes(freq: DataFrame, max_distinct: int | None = None) -> DataFrame:
    """Least frequent, median-frequency and most frequent value of each column.

    Only extremes and a median of counts are gathered for a column, so any number of values has
    its probe. With `max_distinct`, columns of more values have none; `unprobed_columns` names
    them. Ties go to the smaller value.
    """
    spread = _spread(freq)
    if max_distinct is not None:
        spread = spread.where(F.col("distinct_values") <= max_distinct)
    gap = F.abs(F.col("n") - F.col("median_count")).alias("gap")
    # One row per profiled column goes to the frequencies; by the column, all of one would meet in a task.
    nearest = (
        freq.join(F.broadcast(spread.select("column", "median_count")), "column")
        .groupBy("column")
        .agg(F.min(F.struct(gap, "n", "value")).alias("nearest"))
    )

    def tier(method: str, entry: str, count: Column) -> Column:
        return F.struct(
            F.lit(method).alias("method"), F.col(f"{entry}.value").alias("value"), count.alias("row_count")
        )

    return spread.join(nearest, "column").select(
        "column",
        F.inline(
            F.array(
                tier("highly_selective", "rare", F.col("rare.n")),
                tier("moderate_selectivity", "nearest", F.col("nearest.n")),
                tier("most_common_value", "common", -F.col("common.n")),
            )
        ),
    )


def unprobed_columns(freq: DataFrame, max_distinct: int) -> DataFrame:
    """(column, distinct_values, reason) of the columns that `equality_probes` leaves out."""
    counted = freq.groupBy("column").agg(F.count("*").alias("distinct_values"))
    reason = F.concat(F.col("distinct_values"), F.lit(f" distinct values, more than {max_distinct}"))
    return counted.where(F.col("distinct_values") > max_distinct).withColumn("reason", reason)


def ranked_cutoffs(freq: DataFrame) -> DataFrame:
    """(column, tier, cutoff, size, under, up_to): exact interpolated 10, 50 and 90 percent points.

    `under` and `up_to` are the rows less than, and no more than, the cutoff. Ranks come from a
    range-partitioned running count over the frequencies, so no column is gathered into one
    task; at most six frequency rows per column hold the wanted ranks.
    """
    ranked = running_total(freq, ["column"], ["value"], "rank_end", weight=F.col("n"))
    sizes = ranked.groupBy("column").agg(F.max("rank_end").alias("size"))
    wanted = sizes.select(
        "column",
        "size",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("tier"), (F.lit(p) * (F.col("size") - 1)).alias("at")
                    )
                    for name, p in FRACTIONS.items()
                ]
            )
        ),
    ).select("column", "size", "tier", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank"))
    # Six rows per profiled column, sent to the frequencies.
    hits = ranked.join(F.broadcast(wanted.distinct()), "column").where(
        (F.col("rank") < F.col("rank_end")) & (F.col("rank") >= F.col("rank_end") - F.col("n"))
    )
    hit = F.struct("value", "n", "rank_end")
    points = hits.groupBy("column", "size", "tier").agg(
        F.min_by(hit, "rank").alias("below"),
        F.max_by(hit, "rank").alias("above"),
        F.max(F.col("at") - F.floor("at")).alias("share"),
    )
    below, above, cutoff = F.col("below.value"), F.col("above.value"), F.col("cutoff")
    return (
        points.withColumn("cutoff", below + F.col("share") * (above - below))
        .withColumn(
            "under",
            F.when(cutoff > below, F.col("below.rank_end")).otherwise(F.col("below.rank_end") - F.col("below.n")),
        )
        .withColumn("up_to", F.when(cutoff >= above, F.col("above.rank_end")).otherwise(F.col("below.rank_end")))
        .select("column", "tier", "cutoff", "size", "under", "up_to")
    )


def percentile_cutoffs(freq: DataFrame) -> DataFrame:
    """(column, low, mid, high): the cutoffs of a column in one row."""
    return ranked_cutoffs(freq).groupBy("column").pivot("tier", list(FRACTIONS)).agg(F.max("cutoff"))


def numeric_range_probes(cutoffs: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """Each tier of each range predicate with the rows its own operator takes.

    `cutoffs` is `ranked_cutoffs`, whose ranks already are the counts.
    """
    wanted = cutoffs.sparkSession.createDataFrame(
        [(p.column, p.operator, p.parameter_position) for p in predicates],
        "column string, operator string, parameter_position int",
    )
    op, tier = F.col("operator"), F.col("tier")
    selective = F.when(op.isin(">", ">="), "high").otherwise("low")
    method = (
        F.when(tier == "mid", "moderate_selectivity")
        .when(tier == selective, "highly_selective")
        .otherwise("broad_selectivity")
    )
    count = (
        F.when(op == ">", F.col("size") - F.col("up_to"))
        .when(op == ">=", F.col("size") - F.col("under"))
        .when(op == "<", F.col("under"))
        .when(op == "<=", F.col("up_to"))
        .otherwise(0)
    )
    return wanted.join(cutoffs, "column").select(
        "column", "operator", "parameter_position", method.alias("method"), "cutoff",
        count.cast("long").alias("row_count"),
    )


def _recount(freq: DataFrame, tiers: DataFrame) -> DataFrame:
    value, cutoff, op = F.col("value"), F.col("cutoff"), F.col("operator")
    hit = (
        ((op == ">") & (value > cutoff))
        | ((op == ">=") & (value >= cutoff))
        | ((op == "<") & (value < cutoff))
        | ((op == "<=") & (value <= cutoff))
    )
    # Three rows per predicate, sent to the rows: joined by the column, all rows of one would meet in a task.
    return (
        freq.join(F.broadcast(tiers), "column")
        .groupBy("column", "operator", "parameter_position", "method", "cutoff")
        .agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long").alias("row_count"))
    )


def timestamp_window_probes(df: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """7-day, 30-day and full window, anchored at the observed extreme, never at the clock."""
    spark = df.sparkSession
    columns = sorted({p.column for p in predicates})
    moments = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("timestamp_ntz").alias("value"))
                    for c in columns
                ]
            )
        )
    ).where("value IS NOT NULL")
    extremes = moments.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    wanted = spark.createDataFrame(
        [(p.column, p.operator, p.parameter_position) for p in predicates],
        "column string, operator string, parameter_position int",
    )
    ascending = F.col("operator").isin(">", ">=")

    def tier(method: str, days: int) -> Column:
        back = F.expr(f"high - INTERVAL '{days}' DAY")
        ahead = F.expr(f"low + INTERVAL '{days}' DAY")
        return F.struct(
            F.lit(method).alias("method"), F.when(ascending, back).otherwise(ahead).alias("cutoff")
        )

    full = F.struct(
        F.lit("full_window").alias("method"),
        F.when(ascending, F.col("low")).otherwise(F.col("high")).alias("cutoff"),
    )
    tiers = wanted.join(extremes, "column").select(
        "column",
        "operator",
        "parameter_position",
        F.inline(
            F.array(tier("recent_window", RECENT_DAYS), tier("monthly_window", MONTHLY_DAYS), full)
        ),
    )
    return _recount(moments.withColumn("n", F.lit(1)), tiers)


def realized(probes: DataFrame, totals: DataFrame, reveal: bool = False) -> DataFrame:
    """Add total, selectivity (0.0 for an empty table) and the hashed value.

    `probes` holds table_id, value and row_count; the value itself stays only when revealed.
    """
    share = F.coalesce(F.try_divide(F.col("row_count"), F.col("total_row_count")), F.lit(0.0))
    shown = F.col("value") if reveal else F.lit(None).cast("string")
    # One row per table.
    return (
        probes.join(totals, "table_id")
        .withColumn("selectivity", share)
        .withColumn("value_hash", sha256_text("value"))
        .withColumn("is_redacted", F.lit(not reveal))
        .withColumn("redacted_value", shown)
        .drop("value")
    )


def realize_probes(
    tables: dict[str, DataFrame], predicates: Sequence[Predicate], reveal: bool = False
) -> DataFrame:
    """All probes of all predicates, dispatched by kind; each table is scanned per kind."""
    parts: list[DataFrame] = []
    fields = ["column", "operator", "parameter_position", "method", "value", "row_count"]
    for name, df in tables.items():
        mine = [p for p in predicates if p.table_id == name]
        equal = [p for p in mine if p.kind == "equality"]
        numeric = [p for p in mine if p.kind == "numeric_range"]
        moments = [p for p in mine if p.kind == "timestamp_range"]
        found: list[DataFrame] = []
        if equal:
            freq = frequencies(df, sorted({p.column for p in equal}), "string")
            wanted = df.sparkSession.createDataFrame(
                [(p.column, p.operator, p.parameter_position) for p in equal],
                "column string, operator string, parameter_position int",
            )
            found.append(equality_probes(freq).join(wanted, "column").select(*fields))
        if numeric:
            freq = frequencies(df, sorted({p.column for p in numeric}), "double")
            probes = numeric_range_probes(ranked_cutoffs(freq), numeric)
            found.append(probes.withColumn("value", F.col("cutoff").cast("string")).select(*fields))
        if moments:
            probes = timestamp_window_probes(df, moments)
            found.append(probes.withColumn("value", F.col("cutoff").cast("string")).select(*fields))
        parts.extend(part.withColumn("table_id", F.lit(name)) for part in found)
    return realized(reduce(DataFrame.unionByName, parts), table_totals(tables), reveal)


def key_pool(df: DataFrame, key: str) -> DataFrame:
    """(key_value, pool_index): distinct non-null keys with a dense 0-based index."""
    keys = df.select(F.col(key).alias("key_value")).where("key_value IS NOT NULL").distinct()
    return running_total(keys, [], ["key_value"], "_at").select(
        "key_value", (F.col("_at") - 1).alias("pool_index")
    )
