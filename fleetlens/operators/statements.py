"""Lexical statement work: normal form, class, relations, parameters, fingerprint, predicates.

This is a token job, not a grammar. It runs on distinct statements only and is joined back.
Known limits: dollar-quoted text, backslash escapes in E-strings and signed literals are read
token by token; a statement whose first word is not a known statement word, or that holds
more than one statement, is `unsupported` and keeps its raw text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.identity import (
    INTEGER_TYPES,
    NUMERIC_TYPES,
    TIMESTAMP_TYPES,
    comparison_type,
    encode_identity,
)
from fleetlens.functions.nesting import inside_out
from fleetlens.sources.scratch import materialize

# Group loops are possessive: those run in constant stack space on texts of any length.
TOKEN = (
    r"--[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
    r"|[eE]?'(?:[^']++|'')*+'"
    r"|%\([A-Za-z0-9_]+\)s|%s\b|\$[0-9]+"
    r"|(?i:is\s+(?:not\s+)?(?:null|true|false)\b|not\s+null\b)"
    r"|(?:[A-Za-z_][A-Za-z0-9_$]*|\"[^\"]+\")(?:\.(?:[A-Za-z_][A-Za-z0-9_$]*|\"[^\"]+\"|\*))*"
    r"|[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    r"|::|[<>=!~|&#@^?]+|\S"
)
_PLACEHOLDER, _LITERAL = "\x01", "\x02"
_NAME = r"[a-z_\"][a-zA-Z0-9_$\".]*"
_OPERATOR = r"[<>=!~+\-*/%|&^#@]+|like|ilike"

# The class of each statement word.
READ_WORDS = ["select", "values", "table"]
WRITE_WORDS = ["insert", "update", "delete", "merge"]
TRANSACTION_WORDS = [
    "begin",
    "start",
    "commit",
    "end",
    "rollback",
    "abort",
    "savepoint",
    "release",
    "prepare transaction",
]
CONTROL_WORDS = ["set", "reset", "show", "explain"]
SCHEMA_PHRASES = (
    r"^(?:create (?:(?:global |local )?(?:temporary |temp )|unlogged )?table"
    r"|create (?:unique )?index|create schema|alter table|alter index|drop|truncate"
    r"|alter \S+ \S+ rename)\b"
)
OTHER_WORDS = [
    "create",
    "alter",
    "grant",
    "revoke",
    "comment",
    "copy",
    "vacuum",
    "analyze",
    "call",
    "do",
    "lock",
    "listen",
    "notify",
    "refresh",
    "reindex",
    "cluster",
    "declare",
    "fetch",
    "close",
    "prepare",
    "execute",
    "deallocate",
    "discard",
    "checkpoint",
]


def _number_marks(text: Column, mark: str, start: Column) -> Column:
    """Replace each `mark` by `$start+1`, `$start+2`, ... from left to right."""
    pieces = F.split(text, mark)
    numbered = F.transform(
        pieces,
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(F.lit("$"), (start + i).cast("string"), piece)
        ),
    )
    return F.array_join(numbered, "")


def _marked(statement: Column) -> Column:
    """Canonical token text with placeholders and literals replaced by marks."""
    tokens = F.regexp_extract_all(statement, F.lit(TOKEN), F.lit(0))
    kept = F.filter(tokens, lambda t: ~(t.startswith("--") | t.startswith("/*")))

    def rewrite(token: Column) -> Column:
        lowered = F.lower(token)
        return (
            F.when(token.rlike(r"^%(?:\([A-Za-z0-9_]+\))?s$"), _PLACEHOLDER)
            .when(token.rlike(r"^(?:[eE]?'|[0-9])"), _LITERAL)
            .when(lowered.isin("true", "false", "null"), _LITERAL)
            .when(
                token.startswith('"'), F.regexp_replace(token, '"([a-z_][a-z0-9_]*)"', "$1")
            )
            .otherwise(F.regexp_replace(lowered, r"\s+", " "))
        )

    return F.array_join(F.transform(kept, rewrite), " ")


def statement_class(canonical: Column) -> Column:
    """read, write, schema, transaction, control or unsupported, from the leading words."""
    body = inside_out(canonical, lambda text: F.regexp_replace(text, r"\([^()]*\)", ""))
    after_with = F.regexp_extract(body, r"\b(select|insert|update|delete|merge|values)\b", 1)
    first = F.regexp_extract(canonical, r"^\(*\s*([a-z]+)", 1)
    word = F.when(first == "with", after_with).otherwise(first)
    return (
        F.when(word.isin(READ_WORDS), "read")
        .when(word.isin(WRITE_WORDS), "write")
        .when(canonical.rlike(SCHEMA_PHRASES), "schema")
        .when(word.isin(TRANSACTION_WORDS) | canonical.startswith("prepare transaction"), "transaction")
        .when(word.isin(CONTROL_WORDS), "control")
        .otherwise("unsupported")
    )


def normalize_statements(statements: DataFrame, text: str = "statement") -> DataFrame:
    """Distinct statements with their normal form, class and error text.

    Placeholders become `$1..$n` from left to right; literals take the numbers after them.
    """
    marked = statements.select(text).distinct().withColumn("_marked", _marked(F.col(text)))
    known = [*READ_WORDS, *WRITE_WORDS, *TRANSACTION_WORDS, *CONTROL_WORDS, *OTHER_WORDS]
    first = F.regexp_extract("_marked", r"^\(*\s*([a-z]+)", 1)
    error = (
        F.when(
            F.col("_marked").rlike(r";\s*[^\s;]"),
            "exactly one statement is required, found a batch",
        )
        .when(
            ~(first.isin([*known, "with", "drop", "truncate"])),
            "statement word is not recognised",
        )
        .otherwise(F.lit(None).cast("string"))
    )
    body = F.regexp_replace("_marked", r"[\s;]+$", "")
    placeholders = F.size(F.split(body, _PLACEHOLDER)) - 1
    existing = F.coalesce(
        F.array_max(
            F.transform(
                F.regexp_extract_all(body, F.lit(r"\$([0-9]+)"), F.lit(1)),
                lambda n: n.cast("int"),
            )
        ),
        F.lit(0),
    )
    start = F.greatest(placeholders, existing)
    numbered = _number_marks(
        _number_marks(body, _PLACEHOLDER, F.lit(0)), _LITERAL, F.col("_start")
    )
    return (
        marked.withColumn("parse_error", error)
        .withColumn("_start", start)
        .withColumn(
            "parameter_count",
            F.when(F.col("parse_error").isNull(), start + F.size(F.split(body, _LITERAL)) - 1)
            .otherwise(0)
            .cast("long"),
        )
        .withColumn(
            "normalized_sql",
            F.when(F.col("parse_error").isNull(), numbered).otherwise(
                F.when(F.col(text) == "", "<empty>").otherwise(F.col(text))
            ),
        )
        .withColumn(
            "statement_class",
            F.when(F.col("parse_error").isNull(), statement_class(F.col("normalized_sql"))).otherwise(
                "unsupported"
            ),
        )
        .drop("_marked", "_start")
    )


def referenced_names(normalized: Column) -> Column:
    """Names after FROM, JOIN, INTO, UPDATE, USING and TABLE, comma lists included."""
    item = rf"{_NAME}(?: (?:as )?[a-z_][a-z0-9_]*)?"
    lists = F.regexp_extract_all(
        normalized,
        F.lit(rf"\b(?:from|join|into|update|using|table)(?: only)? ((?:{item} , )*+{_NAME})"),
        F.lit(1),
    )
    items = F.flatten(F.transform(lists, lambda part: F.split(part, " , ")))
    return F.array_distinct(F.transform(items, lambda part: F.split_part(part, F.lit(" "), F.lit(1))))


def resolve_relations(normalized: DataFrame, cat_tables: DataFrame) -> DataFrame:
    """Long form (normalized_sql, relation): names found in the catalog, `public` by default."""
    names = (
        normalized.where("parse_error IS NULL")
        .select("normalized_sql")
        .distinct()
        .select("normalized_sql", F.explode(referenced_names(F.col("normalized_sql"))).alias("raw"))
        .withColumn("raw", F.replace("raw", F.lit('"'), F.lit("")))
        .withColumn(
            "schema_name",
            F.when(F.col("raw").contains("."), F.regexp_extract("raw", r"^(.*)\.[^.]*$", 1)).otherwise(
                "public"
            ),
        )
        .withColumn("name", F.substring_index("raw", ".", -1))
    )
    catalog = cat_tables.select("schema_name", "name").distinct()
    return (
        names.join(catalog, ["schema_name", "name"])
        .select("normalized_sql", encode_identity("schema_name", "name").alias("relation"))
        .distinct()
    )


def _without_assignments(normalized: Column) -> Column:
    """Drop the `name =` of SET assignments: an assigned column is not a compared one."""
    assigned = r"\bset (.*?)( where .*| from .*| returning .*)?$"
    assignments = F.regexp_replace(
        F.concat(F.lit(", "), F.regexp_extract(normalized, assigned, 1)), rf", {_NAME} = ", ", "
    )
    rest = F.regexp_replace(normalized, assigned, "$2")
    return F.when(
        normalized.rlike(r"^update\b|\bdo update set\b"), F.concat(rest, F.lit(" "), assignments)
    ).otherwise(normalized)


def parameter_columns(normalized: Column) -> Column:
    """Array of struct(column, position): `column op $n` on either side, casts excluded."""
    normalized = _without_assignments(normalized)
    left = F.regexp_extract_all(
        normalized, F.lit(rf"{_NAME} (?:{_OPERATOR}) \$[0-9]+(?: ::)?"), F.lit(0)
    )
    right = F.regexp_extract_all(
        normalized, F.lit(rf"\$[0-9]+ (?:{_OPERATOR}) {_NAME}"), F.lit(0)
    )

    def parsed(texts: Column, name_at: int, number_at: int) -> Column:
        plain = F.filter(texts, lambda t: ~t.endswith("::"))
        return F.transform(
            plain,
            lambda t: F.struct(
                F.substring_index(F.get(F.split(t, " "), F.lit(name_at)), ".", -1).alias("column"),
                F.substring(F.get(F.split(t, " "), F.lit(number_at)), F.lit(2), F.lit(9))
                .cast("long")
                .alias("position"),
            ),
        )

    return F.concat(parsed(left, 0, 2), parsed(right, 2, 0))


def infer_parameter_types(normalized: DataFrame, cat_columns: DataFrame) -> DataFrame:
    """(normalized_sql, position, data_type); `unknown` when no compared column is known.

    The first catalog column of that name in (table, ordinal) order decides, whichever table
    it belongs to.
    """
    queries = (
        normalized.where("parse_error IS NULL AND parameter_count > 0")
        .select("normalized_sql", "parameter_count")
        .distinct()
    )
    positions = queries.select(
        "normalized_sql", F.explode(F.sequence(F.lit(1).cast("long"), "parameter_count")).alias("position")
    )
    compared = (
        queries.select(
            "normalized_sql", F.posexplode(parameter_columns(F.col("normalized_sql"))).alias("at", "hit")
        )
        .groupBy("normalized_sql", F.col("hit.position").alias("position"))
        .agg(F.min_by("hit.column", "at").alias("column"))
    )
    types = cat_columns.groupBy(F.col("name").alias("column")).agg(
        F.min_by("data_type", F.struct("table_id", "ordinal")).alias("data_type")
    )
    return (
        positions.join(compared, ["normalized_sql", "position"], "left")
        .join(types, "column", "left")
        .select(
            "normalized_sql",
            "position",
            F.coalesce("data_type", F.lit("unknown")).alias("data_type"),
        )
    )


def fingerprint(normalized: Column, relations: Column, types: Column) -> Column:
    """Hash over normal form, sorted relations and positional parameter types."""
    document = F.to_json(
        F.struct(
            normalized.alias("normalized_sql"),
            types.alias("parameter_types"),
            F.array_sort(relations).alias("relations"),
        )
    )
    return F.concat(F.lit("sha256:"), F.sha2(document, 256))


def describe_statements(
    statements: DataFrame, cat_tables: DataFrame, cat_columns: DataFrame
) -> DataFrame:
    """One row per distinct statement with its query id and everything the id covers.

    The lists are bounded by the size of one statement. Distinct statements are few beside the
    events, and are normalized once and kept.
    """
    normalized = materialize(normalize_statements(statements), "statements")
    relations = (
        resolve_relations(normalized, cat_tables)
        .groupBy("normalized_sql")
        .agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    )
    types = (
        infer_parameter_types(normalized, cat_columns)
        .groupBy("normalized_sql")
        .agg(F.array_sort(F.collect_list(F.struct("position", "data_type"))).alias("_types"))
    )
    empty = F.array().cast("array<string>")
    return (
        normalized.join(relations, "normalized_sql", "left")
        .join(types, "normalized_sql", "left")
        .withColumn("relations", F.coalesce("relations", empty))
        .withColumn("parameter_types", F.coalesce(F.col("_types.data_type"), empty))
        .withColumn(
            "query_id",
            fingerprint(F.col("normalized_sql"), F.col("relations"), F.col("parameter_types")),
        )
        .drop("_types", "parameter_count")
    )


def where_terms(normalized: Column) -> Column:
    """AND-ed terms of the outer WHERE; groups with OR, NOT or a subquery are left out."""

    def step(text: Column) -> Column:
        text = F.regexp_replace(text, r"\((?=[^()]*\b(?:or|select)\b)[^()]*\)", "skipped")
        text = F.regexp_replace(text, r"\bnot \([^()]*\)", "skipped")
        return F.regexp_replace(text, r"\(((?:(?!\b(?:or|select)\b)[^()])*+)\)", "$1")

    flat = inside_out(normalized, step)
    where = F.regexp_extract(
        F.regexp_replace(flat, " +", " "),
        r"\bwhere (.*?)(?: group by .*| order by .*| limit .*| offset .*| having .*"
        r"| returning .*| for update.*| union .*)?$",
        1,
    )
    return F.when(where.rlike(r"\bor\b"), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(where, " and "), F.trim)
    )


def predicate_kind(operator: Column, data_type: Column) -> Column:
    base = comparison_type(data_type)
    ordered = operator.isin(">", ">=", "<", "<=")
    return (
        F.when(operator == "=", "equality")
        .when(ordered & base.isin([*INTEGER_TYPES, *NUMERIC_TYPES]), "numeric_range")
        .when(ordered & base.isin(TIMESTAMP_TYPES), "timestamp_range")
    )


def extract_predicates(
    queries: DataFrame, cat_columns: DataFrame, key: str = "query_id"
) -> DataFrame:
    """Probeable `column op $n` comparisons of each query.

    `queries` holds `key`, `normalized_sql` and `relations`. The first relation, in stored
    order, that declares the column wins.
    """
    forward = r"^(?:[a-z0-9_$\"]+\.)*([a-z_][a-z0-9_$]*) ([<>=]+) \$([0-9]+)$"
    backward = r"^\$([0-9]+) ([<>=]+) (?:[a-z0-9_$\"]+\.)*([a-z_][a-z0-9_$]*)$"
    term = F.col("term")
    ahead = F.regexp_extract(term, forward, 1) != ""

    def pick(first: int, second: int) -> Column:
        return F.when(ahead, F.regexp_extract(term, forward, first)).otherwise(
            F.regexp_extract(term, backward, second)
        )

    terms = (
        queries.select(
            key,
            "relations",
            F.posexplode(where_terms(F.col("normalized_sql"))).alias("ordinal", "term"),
        )
        .select(
            key,
            "ordinal",
            pick(1, 3).alias("name"),
            pick(2, 2).alias("operator"),
            pick(3, 1).alias("_position"),
            "relations",
        )
        .where("name <> ''")
        .select("*", F.posexplode("relations").alias("relation_order", "table_id"))
        .drop("relations")
    )
    declared = cat_columns.select("table_id", "name", "data_type")
    return (
        terms.join(declared, ["table_id", "name"])
        .groupBy(key, "ordinal", "name", "operator", "_position")
        .agg(
            F.min_by(F.struct("table_id", "data_type"), "relation_order").alias("hit"),
        )
        .withColumn("kind", predicate_kind(F.col("operator"), F.col("hit.data_type")))
        .where("kind IS NOT NULL")
        .select(
            key,
            "ordinal",
            F.col("hit.table_id").alias("table_id"),
            F.concat(F.col("hit.table_id"), F.lit("."), encode_identity("name")).alias("column_id"),
            F.col("_position").cast("long").alias("parameter_position"),
            "operator",
            "kind",
        )
    )
