"""Deterministic, constraint-respecting data generation.

A value is a pure function of (seed, table, column, generator version, row), so rows come out
the same under any partitioning, and an added table or column shifts nothing else.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import identity
from fleetlens.functions.identity import encode_identity, frame_components, type_family
from fleetlens.functions.nesting import inside_out, outer_pair_dropped
from fleetlens.operators.profile import key_pool
from fleetlens.plans.graphs import cycle_members, peel, shuffled
from fleetlens.plans.ordering import position_by_sequence, running_total
from fleetlens.plans.partitions import dealt
from fleetlens.sources.scratch import materialize

# Spans and limits of the strategies.
FALLBACK_CEILING = 1_000_000
RECENT_DAYS = 365
FALLBACK_DAYS = 3650
UNIQUE_SPAN_FACTOR = 8
UNIQUE_SPAN_FLOOR = 1024
TIMESTAMP_NAMES = ["created_at", "updated_at", "date"]

APP = ["app_id"]


# --- values ----------------------------------------------------------------------------------


def hash60(text: Column) -> Column:
    """The first 60 bits of the sha256 of the text, as a bigint."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def component_seed(seed: int, table: str, component: str, version: int) -> int:
    """60-bit seed of one column stream; the rest of the schema plays no part."""
    text = json.dumps([seed, table, component, version], separators=(",", ":"), ensure_ascii=False)
    return int(hashlib.sha256(text.encode("utf-8")).hexdigest()[:15], 16)


def component_seed_column(seed: Column, table: Column, component: Column, version: Column) -> Column:
    """`component_seed` over columns."""
    return hash60(frame_components(seed, table, component, version))


def row_hash(stream: int | Column, row: Column | str) -> Column:
    """Hash of one row of a column stream."""
    start = F.lit(stream) if isinstance(stream, int) else stream
    index = F.col(row) if isinstance(row, str) else row
    return hash60(F.concat_ws(":", start.cast("string"), index.cast("string")))


def unique_spread(stream: int, needed: int) -> tuple[int, int, int]:
    """(multiplier, shift, span) of a permutation of 0..span-1."""
    span = max(needed * UNIQUE_SPAN_FACTOR, UNIQUE_SPAN_FLOOR)
    limit = max(2, min(span, (1 << 62) // span))
    multiplier = stream % limit | 1
    while math.gcd(multiplier, span) != 1:
        multiplier += 2
    return multiplier, stream % span, span


def unique_values(
    spark: SparkSession, stream: int, rows: int, existing: DataFrame, prefix: str | None = None
) -> DataFrame:
    """(row, value): `rows` distinct values that `existing` (one column) does not hold.

    Whole numbers, or `prefix-00000042` text. A permutation gives distinct candidates without
    a list; at most as many candidates as there are existing values fall away.
    """
    held = existing.select(F.col(existing.columns[0]).alias("value")).where("value IS NOT NULL").distinct()
    needed = rows + held.count()
    multiplier, shift, span = unique_spread(stream, needed)
    number = (F.col("id") * multiplier + shift) % span + 1
    value = number if prefix is None else F.concat(F.lit(f"{prefix}-"), F.lpad(number.cast("string"), 8, "0"))
    if prefix is not None:
        # Numbers beyond eight digits keep all of them.
        value = F.when(number < 100_000_000, value).otherwise(F.concat(F.lit(f"{prefix}-"), number))
    fresh = spark.range(needed).withColumn("value", value).join(held, "value", "left_anti")
    placed = position_by_sequence(fresh, [], "id", "place")
    return placed.where(F.col("place") <= rows).select((F.col("place") - 1).alias("row"), "value")


def foreign_key_values(rows: DataFrame, stream: int, pool: DataFrame, out: str) -> DataFrame:
    """Add `out`, picked with replacement from `pool` (key_value, pool_index); null when empty."""
    size = pool.count()
    if size == 0:
        return rows.withColumn(out, F.lit(None).cast(pool.schema["key_value"].dataType))
    picked = rows.withColumn("pool_index", F.pmod(row_hash(stream, "row"), F.lit(size)))
    return picked.join(pool, "pool_index", "left").withColumnRenamed("key_value", out).drop("pool_index")


def pick(stream: int | Column, literals: Column) -> Column:
    """One of the literals."""
    at = F.pmod(row_hash(stream, "row"), F.size(literals).cast("bigint"))
    return F.get(literals, at.cast("int"))


def in_range(stream: int | Column, low: Column, high: Column) -> Column:
    """Whole number in [low, high]."""
    return low + F.pmod(row_hash(stream, "row"), high - low + 1)


def moment(stream: int | Column, epoch: Column, days: Column | int) -> Column:
    """A time up to `days` before the epoch, never after it."""
    span = (F.lit(days) if isinstance(days, int) else days).cast("bigint") * 86_400
    return F.timestamp_add("SECOND", -F.pmod(row_hash(stream, "row"), span), epoch)


def email() -> Column:
    return F.concat(F.lit("user"), F.col("row"), F.lit("@example.test"))


def fallback(family: str | None, stream: int, name: str, epoch: Column) -> Column:
    """The last tier: whole numbers, two-place numbers, `name-row` text, far-back times, else null."""
    if family == "integer":
        return F.pmod(row_hash(stream, "row"), F.lit(FALLBACK_CEILING))
    if family == "numeric":
        return (F.pmod(row_hash(stream, "row"), F.lit(FALLBACK_CEILING * 100)) / 100).cast("double")
    if family == "text":
        return F.concat(F.lit(f"{name}-"), F.col("row"))
    if family == "timestamp":
        return moment(stream, epoch, FALLBACK_DAYS)
    return F.lit(None).cast("string")


# --- checks ----------------------------------------------------------------------------------

_LITERAL = r"(?:'(?:[^']++|'')*+'|-?\d+(?:\.\d+)?|true|false)"
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


def _bare_literal(text: Column) -> Column:
    inner = F.regexp_replace(text, r"^'([\s\S]*)'$", "$1")
    return F.when(text.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(text)


def recognize_checks(constraints: DataFrame, expression: str = "expression") -> DataFrame:
    """Add check_column, check_kind (set, range or null), literals, low and high.

    Whole expressions are matched: a known shape inside a larger expression gives nothing. Casts
    are dropped first. An open range reaches 1,000,000 beyond its bound.
    """
    text = F.trim(F.regexp_replace(F.col(expression), r"\s+", " "))
    text = F.regexp_replace(
        text,
        r"::(?:character varying|double precision|timestamp (?:with|without) time zone|[a-z_]+)(?:\(\d+(?:, ?\d+)?\))?(?:\[\])?",
        "",
    )
    single = rf"{_NAME} (?:=|>=|<=|>|<) {_LITERAL}"

    def step(part: Column) -> Column:
        part = F.regexp_replace(part, rf"(?<![A-Za-z0-9_])\(({_NAME})\)", "$1")
        part = F.regexp_replace(part, rf"(?<![A-Za-z0-9_])\(({_LITERAL})\)(?=\)| |$)", "$1")
        return F.regexp_replace(part, rf"(?<!NOT |not |[A-Za-z0-9_])\(({single})\)", "$1")

    listed = rf"^({_NAME}) (?:IN|in) \(({_LITERAL}(?:, ?{_LITERAL})*+)\)$"
    array = rf"^({_NAME}) = (?:ANY|any) \(+(?:ARRAY|array)\[({_LITERAL}(?:, ?{_LITERAL})*+)\]\)+$"
    equality = rf"({_NAME}) = ({_LITERAL})"
    either = rf"^{equality}(?: (?:OR|or) \1 = {_LITERAL})*$"
    between = rf"^({_NAME}) (?:BETWEEN|between) (-?\d+) (?:AND|and) (-?\d+)$"
    bound = rf"{_NAME} (?:>=|<=|>|<) -?\d+"
    bounds = rf"^(?=({_NAME}) ){bound}(?: (?:AND|and) \1 (?:>=|<=|>|<) -?\d+)*$"

    # A column for each stage: as one expression, the text would be worked out anew for each mention.
    body = F.col("_text")
    df = constraints.withColumn("_text", text).withColumn("_text", inside_out(body, step))
    df = df.withColumn("_text", inside_out(body, outer_pair_dropped))
    several = rf"^({_NAME}) = {_LITERAL} (?:OR|or) "
    in_list = body.rlike(listed)
    in_array = body.rlike(array)
    in_or = body.rlike(either) & body.rlike(several)
    literals = F.when(
        in_list | in_array,
        F.regexp_extract_all(
            F.when(in_list, F.regexp_extract(body, listed, 2)).otherwise(F.regexp_extract(body, array, 2)),
            F.lit(f"({_LITERAL})"),
            F.lit(1),
        ),
    ).when(in_or, F.regexp_extract_all(body, F.lit(rf" = ({_LITERAL})"), F.lit(1)))
    in_between = body.rlike(between)
    in_bounds = body.rlike(bounds)
    parts = F.regexp_extract_all(body, F.lit(r"((?:>=|<=|>|<) -?\d+)"), F.lit(1))

    def limits(operators: tuple[str, str], step: int) -> Column:
        wide, strict = operators
        mine = F.filter(parts, lambda p: p.startswith(wide) | (p.startswith(strict) & ~p.startswith(strict + "=")))
        return F.transform(
            mine,
            lambda p: F.regexp_extract(p, r"(-?\d+)$", 1).cast("bigint")
            + F.when(p.startswith(wide), 0).otherwise(step),
        )

    lower, upper = limits((">=", ">"), 1), limits(("<=", "<"), -1)
    reach = F.lit(FALLBACK_CEILING).cast("bigint")
    low = F.when(in_between, F.regexp_extract(body, between, 2).try_cast("bigint")).when(
        in_bounds, F.coalesce(F.try_element_at(lower, F.lit(-1)), F.get(upper, F.lit(0)) - reach)
    )
    high = F.when(in_between, F.regexp_extract(body, between, 3).try_cast("bigint")).when(
        in_bounds, F.coalesce(F.try_element_at(upper, F.lit(-1)), F.get(lower, F.lit(0)) + reach)
    )
    ranged = (in_between | in_bounds) & (F.col("low") <= F.col("high"))
    kind = F.when(F.col("literals").isNotNull(), "set").when(ranged, "range")
    return (
        df.withColumn("literals", F.array_sort(F.transform(literals, _bare_literal)))
        .withColumn("low", low)
        .withColumn("high", high)
        .withColumn("check_kind", kind)
        .withColumn("low", F.when(F.col("check_kind") == "range", F.col("low")))
        .withColumn("high", F.when(F.col("check_kind") == "range", F.col("high")))
        .withColumn(
            "check_column",
            F.when(F.col("check_kind").isNotNull(), F.regexp_extract(body, rf"^({_NAME})", 1)),
        )
        .drop("_text")
    )


# --- plans -----------------------------------------------------------------------------------


def database_default() -> Column:
    return (
        F.col("is_identity")
        | F.col("is_generated")
        | F.coalesce(F.col("default_expression").contains("nextval("), F.lit(False))
    )


def unique_columns(columns: DataFrame, constraints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique, unsupported): single-column keys with a distinctness strategy, and those without.

    Columns the database fills by itself and composite keys are in neither.
    """
    keyed = (
        constraints.where("kind IN ('primary_key', 'unique') AND size(columns) = 1")
        .select("app_id", F.get("columns", F.lit(0)).alias("column_id"))
        .distinct()
    )
    own = (
        columns.join(keyed, ["app_id", "column_id"], "left_semi")
        .where(~database_default())
        .withColumn("family", type_family("data_type"))
    )
    able = F.coalesce(F.col("family").isin("integer", "text"), F.lit(False))
    unsupported = own.where(~able).select(
        "app_id",
        F.concat("column_id", F.lit(": no distinctness strategy for "), "data_type").alias("reason"),
    )
    return own.where(able).select("app_id", "column_id"), unsupported


def plan_columns(
    columns: DataFrame,
    constraints: DataFrame,
    pools: DataFrame,
    deferred: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(assumptions, unsupported): the strategy of every column, and what has none.

    `pools` holds (app_id, table_id, pool_size) of tables with parent keys, `deferred` (app_id,
    column_id). A table with a NOT NULL column that has no source gets no assumptions at all.
    """
    on = ["app_id", "column_id"]
    single = constraints.where("kind = 'foreign_key' AND referenced_table IS NOT NULL AND size(columns) = 1")
    parents = (
        single.groupBy("app_id", F.get("columns", F.lit(0)).alias("column_id"))
        .agg(F.max_by("referenced_table", F.struct("ordinal", "name")).alias("parent"))
        .join(
            pools.select("app_id", F.col("table_id").alias("parent"), "pool_size"), ["app_id", "parent"], "left"
        )
        .withColumn("pool_size", F.coalesce("pool_size", F.lit(0).cast("long")))
    )
    unique, no_distinct = unique_columns(columns, constraints)
    # Checks often stand together in a table, and each takes long: dealt out, and read once.
    checks = materialize(
        recognize_checks(
            dealt(
                constraints.where("kind = 'check' AND expression IS NOT NULL").select(
                    "app_id", "table_id", "name", "expression", "ordinal"
                )
            )
        ),
        "checks",
    )
    named = checks.withColumn(
        "column_id", F.concat_ws(".", "table_id", encode_identity("check_column"))
    ).join(columns.select(*on).withColumn("known", F.lit(True)), on, "left")
    usable = (
        named.where("check_kind IS NOT NULL AND known")
        .groupBy(*on)
        .agg(F.max_by(F.struct("check_kind", "literals", "low", "high"), F.struct("ordinal", "name")).alias("check"))
    )
    planned = (
        columns.join(parents, on, "left")
        .join(unique.withColumn("is_unique", F.lit(True)), on, "left")
        .join(usable, on, "left")
        .join(deferred.withColumn("is_deferred", F.lit(True)), on, "left")
        .withColumn("family", type_family("data_type"))
    )
    name, family = F.lower("name"), F.col("family")
    timely = name.contains("_at") | name.isin(TIMESTAMP_NAMES)
    strategy = (
        F.when(F.col("is_deferred"), "deferred_foreign_key")
        .when(F.col("parent").isNotNull() & (F.col("pool_size") > 0), "foreign_key")
        .when(F.col("parent").isNotNull(), F.lit(None))
        .when(database_default(), "database_default")
        .when(F.col("is_unique") & (family == "integer"), "unique_sequential_int")
        .when(F.col("is_unique"), "unique_sequential_text")
        .when(family == "boolean", "boolean")
        .when(F.col("check.check_kind") == "set", "check_recognized_set")
        .when((F.col("check.check_kind") == "range") & (family == "integer"), "check_recognized_range")
        .when((family == "timestamp") & timely, "timestamp_heuristic")
        .when((family == "text") & name.contains("email"), "email_heuristic")
        .when(family.isin("integer", "numeric", "text", "timestamp"), "uniform_fallback")
    )
    judged = planned.withColumn("_strategy", strategy)
    broken = judged.where("_strategy IS NULL AND NOT nullable").select(
        "app_id",
        "table_id",
        F.concat("column_id", F.lit(": no value source for a NOT NULL "), "data_type").alias("reason"),
    )
    inferred = ["timestamp_heuristic", "email_heuristic", "uniform_fallback", "null_fallback"]
    assumptions = (
        judged.join(broken.select("app_id", "table_id").distinct(), ["app_id", "table_id"], "left_anti")
        .withColumn("strategy", F.coalesce("_strategy", F.lit("null_fallback")))
        .withColumn("inferred", F.col("strategy").isin(inferred))
        .select(
            "app_id", "table_id", "column_id", "name", "data_type", "strategy", "inferred", "parent",
            "check.literals", "check.low", "check.high",
        )
    )

    def reason(frame: DataFrame, kind: str, text: Column | str) -> DataFrame:
        return frame.select(
            "app_id",
            F.lit(kind).alias("kind"),
            (F.col(text) if isinstance(text, str) else text).alias("reason"),
        )

    composite = constraints.where(
        "kind = 'foreign_key' AND referenced_table IS NOT NULL AND size(columns) <> 1"
    )
    unsupported = (
        reason(named.where("check_kind IS NULL OR known IS NULL"), "unsupported_check_constraint", "expression")
        .unionByName(reason(composite, "unsupported_composite_foreign_key", "name"))
        .unionByName(reason(no_distinct, "unsupported_unique_constraint", "reason"))
        .unionByName(reason(broken, "unsupported_column_type", "reason"))
    )
    return assumptions, unsupported


def table_order(
    tables: DataFrame, foreign_keys: DataFrame, columns: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(order, deferred, unsupported): parents before children, ties by name.

    A cycle whose inner key columns are all nullable keeps its tables and defers those columns;
    any other cycle drops its tables. `foreign_keys` holds app_id, table_id, referenced_table
    and columns.
    """
    ids = tables.select("app_id", "table_id")
    known = materialize(
        foreign_keys.join(shuffled(ids), ["app_id", "table_id"], "left_semi")
        .join(shuffled(ids.withColumnRenamed("table_id", "referenced_table")), ["app_id", "referenced_table"], "left_semi")
        .select("app_id", "table_id", "referenced_table", "columns"),
        "keys",
    )
    edges = known.select(
        "app_id", F.col("table_id").alias("child"), F.col("referenced_table").alias("parent")
    ).distinct()
    members = materialize(cycle_members(edges, APP), "cycles")
    child = members.select("app_id", F.col("node").alias("table_id"), "component")
    parent = members.select("app_id", F.col("node").alias("referenced_table"), F.col("component").alias("parent_component"))
    inside = materialize(
        known.join(shuffled(child), ["app_id", "table_id"])
        .join(shuffled(parent), ["app_id", "referenced_table"])
        .where("component = parent_component")
        .drop("parent_component"),
        "inner-keys",
    )
    nullable = columns.where("nullable").select("app_id", "column_id", F.lit(True).alias("is_nullable"))
    used = inside.select("app_id", "component", F.explode("columns").alias("column_id")).join(
        shuffled(nullable), ["app_id", "column_id"], "left"
    )
    verdict = used.groupBy("app_id", "component").agg(
        F.bool_and(F.coalesce("is_nullable", F.lit(False))).alias("kept")
    )
    deferred = used.join(shuffled(verdict.where("kept")), ["app_id", "component"], "left_semi").select("app_id", "column_id").distinct()
    lost = members.join(shuffled(verdict.where("kept")), ["app_id", "component"], "left_anti")
    reasons = (
        lost.groupBy("app_id", "component")
        .agg(F.array_sort(F.collect_list("node")).alias("names"))
        .select(
            "app_id",
            F.lit("fk_cycle").alias("kind"),
            F.concat(F.lit("non-null foreign key cycle: "), F.array_join("names", ", ")).alias("reason"),
        )
    )
    dropped = lost.select("app_id", F.col("node").alias("table_id"))
    broken = inside.select("app_id", F.col("table_id").alias("child"), F.col("referenced_table").alias("parent"))
    remaining = (
        edges.where("child <> parent")
        .join(shuffled(broken), ["app_id", "child", "parent"], "left_anti")
        .join(shuffled(dropped.withColumnRenamed("table_id", "child")), ["app_id", "child"], "left_anti")
        .join(shuffled(dropped.withColumnRenamed("table_id", "parent")), ["app_id", "parent"], "left_anti")
    )
    levels, _stuck = peel(remaining, APP)
    placed = (
        ids.join(shuffled(dropped), ["app_id", "table_id"], "left_anti")
        .join(shuffled(levels.withColumnRenamed("node", "table_id")), ["app_id", "table_id"], "left")
        .withColumn("level", F.coalesce("level", F.lit(0)))
    )
    return running_total(placed, APP, ["level", "table_id"], "position"), deferred, reasons


# --- tables ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnSpec:
    """How one column of one generated table gets its values."""

    name: str
    data_type: str
    strategy: str
    parent: str | None = None
    parent_key: str | None = None
    literals: tuple[str, ...] = ()
    low: int = 0
    high: int = 0


@dataclass(frozen=True)
class TableSpec:
    """One table to fill up to `target` rows. Parents come before children in a list of these."""

    table_id: str
    target: int
    columns: tuple[ColumnSpec, ...]


_SPARK_TYPES = {"integer": "bigint", "numeric": "double", "text": "string", "boolean": "boolean", "timestamp": "timestamp_ntz"}


def family_of(data_type: str) -> str | None:
    families = {
        "integer": identity.INTEGER_TYPES,
        "numeric": identity.NUMERIC_TYPES,
        "text": identity.TEXT_TYPES,
        "boolean": identity.BOOLEAN_TYPES,
        "timestamp": identity.TIMESTAMP_TYPES,
    }
    base = data_type.split("(")[0].strip().lower()
    return next((name for name, types in families.items() if base in types), None)


def generate_rows(
    spark: SparkSession,
    spec: TableSpec,
    rows: int,
    seed: int,
    epoch: str,
    pools: dict[str, DataFrame],
    existing: DataFrame | None = None,
    version: int = 1,
) -> DataFrame:
    """`rows` new rows of one table; `existing` supplies the unique values to stay clear of.

    `pools` maps `table.key` to (key_value, pool_index).
    """
    at = F.lit(epoch).cast("timestamp_ntz")
    out = spark.range(rows).withColumnRenamed("id", "row")
    for c in spec.columns:
        stream = component_seed(seed, spec.table_id, f"{spec.table_id}.{c.name}", version)
        family = family_of(c.data_type)
        kind = _SPARK_TYPES.get(family or "", "string")
        if c.strategy in ("unique_sequential_int", "unique_sequential_text"):
            held = existing.select(c.name) if existing is not None else spark.range(0).select(F.col("id").cast(kind).alias(c.name))
            prefix = c.name if c.strategy.endswith("text") else None
            values = unique_values(spark, stream, rows, held, prefix)
            out = out.join(values.withColumnRenamed("value", c.name), "row")
        elif c.strategy == "foreign_key":
            out = foreign_key_values(out, stream, pools[f"{c.parent}.{c.parent_key}"], c.name)
        elif c.strategy == "deferred_foreign_key":
            out = out.withColumn(c.name, F.lit(None).cast(kind))
        elif c.strategy == "boolean":
            out = out.withColumn(c.name, pick(stream, F.array(F.lit(True), F.lit(False))))
        elif c.strategy == "check_recognized_set":
            out = out.withColumn(c.name, pick(stream, F.array(*[F.lit(x) for x in c.literals])).cast(kind))
        elif c.strategy == "check_recognized_range":
            out = out.withColumn(c.name, in_range(stream, F.lit(c.low), F.lit(c.high)))
        elif c.strategy == "timestamp_heuristic":
            out = out.withColumn(c.name, moment(stream, at, RECENT_DAYS))
        elif c.strategy == "email_heuristic":
            out = out.withColumn(c.name, email())
        else:
            out = out.withColumn(c.name, fallback(family, stream, c.name, at))
    return out.select(*[c.name for c in spec.columns])


def load_dataset(
    spark: SparkSession, specs: Sequence[TableSpec], root: str, seed: int, epoch: str
) -> dict[str, tuple[int, int]]:
    """Fill tables below `root` up to their targets; (existing, added) rows per table.

    Existing rows stay; only the shortfall is generated and appended, in list order, so pools
    hold the parents' rows. A second call with the same targets adds nothing. The loop runs
    over table descriptions, never over rows.
    """
    report: dict[str, tuple[int, int]] = {}
    for spec in specs:
        path = f"{root}/{spec.table_id}"
        current = _existing(spark, path)
        have = current.count() if current is not None else 0
        missing = max(0, spec.target - have)
        report[spec.table_id] = (have, missing)
        if not missing:
            continue
        pools = {}
        for c in spec.columns:
            if c.strategy == "foreign_key" and c.parent and c.parent_key:
                parent = _existing(spark, f"{root}/{c.parent}")
                if parent is None:
                    raise ValueError(f"{c.parent} must be filled before {spec.table_id}")
                pools[f"{c.parent}.{c.parent_key}"] = key_pool(parent, c.parent_key)
        fresh = generate_rows(spark, spec, missing, seed, epoch, pools, current)
        fresh.write.mode("append").parquet(path)
    return report


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if system.exists(folder) else None


def fill_deferred(table: DataFrame, key: str, column: str, stream: int, pool: DataFrame) -> DataFrame:
    """Give a deferred key column its values now that its parents exist.

    `key` is the table's own whole-number key and numbers the rows.
    """
    picked = foreign_key_values(
        table.drop(column).withColumn("row", F.col(key)), stream, pool, column
    )
    return picked.drop("row").select(*table.columns)


def storefront(spark: SparkSession, tenants: int, users: int, products: int, orders: int, items: int) -> dict[str, DataFrame]:
    """Storefront rows by arithmetic on a row number; no chance and no clock.

    The defaults of the published data set are 200, 20,000, 2,000, 400,000 and 800,000 rows.
    """
    i = F.col("i")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    tenant = (i - 1) % tenants + 1
    # The status of ten orders in a row of one tenant.
    statuses = ["paid"] * 6 + ["pending"] * 2 + ["shipped", "cancelled"]
    status = F.get(
        F.array(*[F.lit(s) for s in statuses]), (F.floor((i - 1) / tenants) % 10).cast("int")
    )

    def numbered(count: int) -> DataFrame:
        return spark.range(1, count + 1).withColumnRenamed("id", "i")

    return {
        "tenants": numbered(tenants).select(
            i.alias("id"),
            F.concat(F.lit("tenant-"), F.lpad(i.cast("string"), 4, "0")).alias("slug"),
            F.concat(F.lit("Tenant "), i).alias("name"),
            start.alias("created_at"),
        ),
        "users": numbered(users).select(
            i.alias("id"),
            tenant.alias("tenant_id"),
            F.concat(F.lit("user"), i, F.lit("@tenant"), tenant, F.lit(".test")).alias("email"),
            start.alias("created_at"),
        ),
        "products": numbered(products).select(
            i.alias("id"),
            tenant.alias("tenant_id"),
            F.concat(F.lit("SKU-"), F.lpad(i.cast("string"), 6, "0")).alias("sku"),
            F.concat(F.lit("Product "), i).alias("name"),
            (500 + i % 400 * 7).alias("price_cents"),
        ),
        "orders": numbered(orders).select(
            i.alias("id"),
            tenant.alias("tenant_id"),
            ((i - 1) % users + 1).alias("user_id"),
            status.alias("status"),
            (1000 + i % 500 * 13).alias("total_cents"),
            F.timestamp_add("MINUTE", i * 7919 % orders, start).alias("created_at"),
        ),
        "order_items": numbered(items).select(
            i.alias("id"),
            ((i - 1) % orders + 1).alias("order_id"),
            ((i - 1) % products + 1).alias("product_id"),
            (1 + i % 4).alias("quantity"),
            (500 + i % 400 * 7).alias("unit_price_cents"),
        ),
    }


# --- validation ------------------------------------------------------------------------------


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Non-null child keys with no parent, with their row count."""
    keys = parent.select(F.col(key).alias("value")).distinct()
    used = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    return used.join(keys, "value", "left_anti")


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).where("rows > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): rows that break each rule, all rules in one pass; null passes a check."""
    counts = [
        F.count_if(~F.coalesce(condition, F.lit(True))).alias(name) for name, condition in rules.items()
    ]
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules])
    return df.agg(*counts).select(F.inline(pairs))
