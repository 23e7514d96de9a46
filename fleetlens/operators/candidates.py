"""Index candidates from extracted predicates, checked against existing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.identity import identity_part

MAX_CANDIDATES = 5


def existing_key_sequences(indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """(app_id, table_id, priority, name, sequence) of keys that can make a candidate redundant.

    Plain full-table ascending b-trees, then primary keys and unique constraints. One
    descending or expression key takes the whole index out.
    """
    plain = F.forall("keys", lambda k: k["column"].isNotNull() & (k["direction"] == "asc"))
    usable = indexes.where(
        (F.col("method") == "btree") & F.col("predicate").isNull() & (F.size("keys") > 0) & plain
    ).select(
        "app_id",
        "table_id",
        F.struct(F.lit(0).alias("source"), "name").alias("priority"),
        "name",
        F.col("keys")["column"].alias("sequence"),
    )
    keyed = constraints.where(
        "kind IN ('primary_key', 'unique') AND expression IS NULL AND size(columns) > 0"
    ).select(
        "app_id",
        "table_id",
        F.struct(F.lit(1).alias("source"), "name").alias("priority"),
        "name",
        F.col("columns").alias("sequence"),
    )
    return usable.unionByName(keyed)


def prefix_owners(sequences: DataFrame) -> DataFrame:
    """(app_id, table_id, columns, owner): the first existing key for every key prefix.

    Keys hold a handful of columns, so all prefixes are listed and matched by equality.
    """
    prefixes = sequences.select(
        "app_id",
        "table_id",
        "priority",
        "name",
        "sequence",
        F.explode(F.sequence(F.lit(1), F.size("sequence"))).alias("length"),
    ).select("app_id", "table_id", "priority", "name", F.expr("slice(sequence, 1, length)").alias("columns"))
    return prefixes.groupBy("app_id", "table_id", "columns").agg(
        F.min_by("name", "priority").alias("owner")
    )


def candidate_shapes(predicates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_id, table_order, shape_order, columns): wanted key lists of each query.

    Composites first: all equalities with the first range, then all equalities when there are
    several, then each single column. A list is bounded by one statement's predicates.
    """
    listed = predicates.groupBy(*keys, "table_id").agg(
        F.min("ordinal").alias("table_order"),
        F.array_sort(F.collect_list(F.struct("ordinal", "column_id", "kind"))).alias("found"),
    )
    equal = F.filter("found", lambda p: p["kind"] == "equality")["column_id"]
    ranged = F.filter("found", lambda p: p["kind"] != "equality")["column_id"]
    empty = F.array().cast("array<array<string>>")
    shapes = F.concat(
        F.when(
            (F.size(equal) > 0) & (F.size(ranged) > 0),
            F.array(F.concat(equal, F.slice(ranged, 1, 1))),
        ).otherwise(empty),
        F.when(F.size(equal) >= 2, F.array(equal)).otherwise(empty),
        F.transform("found", lambda p: F.array(p["column_id"])),
    )
    return listed.select(
        *keys,
        "table_id",
        "table_order",
        F.posexplode(F.array_distinct(shapes)).alias("shape_order", "columns"),
    )


def prefix_duplicates(shapes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Add `owner`, the first existing key the candidate is a prefix of, else null."""
    return shapes.join(prefix_owners(sequences), ["app_id", "table_id", "columns"], "left")


def _names(columns: Column) -> Column:
    return F.transform(columns, lambda c: identity_part(c, 3))


def candidate_ddl(candidates: DataFrame) -> DataFrame:
    """Add index name, CREATE and DROP text."""
    schema, name = identity_part("table_id", 1), identity_part("table_id", 2)
    columns = _names(F.col("columns"))
    index = F.concat(F.lit("ix_"), name, F.lit("_"), F.array_join(columns, "_"))
    quote = F.lit('"')
    return (
        candidates.withColumn("name", index)
        .withColumn(
            "apply_sql",
            F.concat(
                F.lit("CREATE INDEX "), F.col("name"), F.lit(" ON "),
                quote, schema, F.lit('"."'), name, F.lit('" ('), F.array_join(columns, ", "), F.lit(")"),
            ),
        )
        .withColumn(
            "revert_sql",
            F.concat(F.lit("DROP INDEX "), quote, schema, F.lit('"."'), F.col("name"), quote),
        )
    )


def judge_candidates(
    predicates: DataFrame, sequences: DataFrame, keys: list[str], budget: int = MAX_CANDIDATES
) -> DataFrame:
    """Every candidate with `reason`: null when accepted.

    At most `budget` are accepted per query, over all its tables; the duplicate check comes
    before the budget. `keys` starts with app_id; a query's candidates come from one statement.
    """
    checked = prefix_duplicates(candidate_shapes(predicates, keys), sequences)
    order = Window.partitionBy(*keys, F.col("owner").isNull()).orderBy(
        "table_order", "table_id", "shape_order"
    )
    reason = F.when(
        F.col("owner").isNotNull(), F.concat(F.lit("duplicate_of_existing_index:"), "owner")
    ).when(F.col("place") > budget, "over_candidate_budget")
    return (
        checked.withColumn("place", F.row_number().over(order))
        .withColumn("reason", reason)
        .select(*keys, "table_id", "columns", "table_order", "shape_order", "reason")
    )


def index_candidates(
    predicates: DataFrame, sequences: DataFrame, keys: list[str], budget: int = MAX_CANDIDATES
) -> DataFrame:
    """Accepted candidates with their names and DDL."""
    judged = judge_candidates(predicates, sequences, keys, budget)
    return candidate_ddl(judged.where("reason IS NULL").drop("reason"))
