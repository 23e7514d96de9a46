"""Identity, hash and text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the public record formats.
SHA256_PATTERN = "^sha256:[0-9a-f]{64}$"
SCHEMA_VERSION_PATTERN = "^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$"
RUN_ID_PATTERN = "^[0-9A-HJKMNP-TV-Z]{26}$"
DECIMAL_PATTERN = "^-?(0|[1-9][0-9]*)(\\.[0-9]+)?$"
SNAKE_CASE_PATTERN = "^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"
RFC3339_UTC_PATTERN = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d{1,9})?Z$"
RULE_ID_PATTERN = "^[a-z][a-z0-9_]*(?:\\.[a-z][a-z0-9_]*)+$"
RECOMMENDATION_ID_PATTERN = "^[A-Z][A-Z0-9]{1,15}-[0-9]{3,6}$"
NODE_KIND_PATTERN = "^[a-z][a-z0-9_]*$"
NODE_ID_PATTERN = "^[a-z][a-z0-9_]*:[^\\x00]{1,512}$"
OPERATION_ID_PATTERN = "^[a-z][a-z0-9_]*::[^\\x00]{1,300}$"
PROOF_ID_PATTERN = "^[A-Z][A-Z0-9]{1,15}-[0-9]{3,6}@sha256:[0-9a-f]{64}$"
INTEGER_TYPES = ["integer", "bigint", "smallint", "int", "int2", "int4", "int8"]
NUMERIC_TYPES = ["numeric", "decimal", "real", "double precision", "float", "float4", "float8"]
TEXT_TYPES = ["text", "character varying", "varchar", "character", "char", "bpchar"]
BOOLEAN_TYPES = ["boolean", "bool"]
TIMESTAMP_TYPES = [
    "timestamp",
    "timestamptz",
    "timestamp with time zone",
    "timestamp without time zone",
    "date",
]


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def base_type(data_type: Column | str) -> Column:
    """The type name without its `(n[,m])` modifier, trimmed, lower case."""
    bare = F.regexp_replace(column(data_type), r"\(\s*\d+\s*(?:,\s*\d+\s*)?\)", "")
    return F.lower(F.trim(bare))


def comparison_type(data_type: Column | str) -> Column:
    """The type name cut at its first parenthesis."""
    return F.lower(F.trim(F.split_part(column(data_type), F.lit("("), F.lit(1))))


def type_family(data_type: Column | str) -> Column:
    """integer, numeric, text, boolean or timestamp; null for arrays and everything else."""
    base = base_type(data_type)
    return (
        F.when(base.endswith("]"), F.lit(None).cast("string"))
        .when(base.isin(INTEGER_TYPES), "integer")
        .when(base.isin(NUMERIC_TYPES), "numeric")
        .when(base.isin(TEXT_TYPES), "text")
        .when(base.isin(BOOLEAN_TYPES), "boolean")
        .when(base.isin(TIMESTAMP_TYPES), "timestamp")
    )


def sha256_text(value: Column | str) -> Column:
    """`sha256:` and the hex digest of the UTF-8 text."""
    return F.concat(F.lit("sha256:"), F.sha2(column(value).cast("string"), 256))


def stripped(value: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def split_list(value: Column | str) -> Column:
    """Comma parts, trimmed, empty ones dropped."""
    parts = F.transform(F.split(column(value), ","), stripped)
    return F.filter(parts, lambda part: part != "")


def split_two(value: Column | str) -> Column:
    """`struct(first, second)`; the second is null when missing, and the first is then whole."""
    parts = F.transform(F.split(column(value), ",", 2), stripped)
    second = F.get(parts, F.lit(1))
    whole = second.isNull() | (second == "")
    return F.struct(
        F.when(whole, stripped(column(value))).otherwise(F.get(parts, F.lit(0))).alias("first"),
        F.when(~whole, second).alias("second"),
    )


def safe_id(value: Column | str) -> Column:
    """Every character outside `[A-Za-z0-9_]` becomes `_`."""
    return F.regexp_replace(column(value), "[^A-Za-z0-9_]", "_")


def is_repository_path(value: Column | str) -> Column:
    """Relative POSIX path with no empty, `.` or `..` segment."""
    path = column(value)
    segments = F.split(path, "/")
    return (
        (F.length(path) > 0)
        & ~path.contains("\\")
        & ~path.contains("\x00")
        & ~path.startswith("/")
        & ~path.startswith("~")
        & ~path.rlike("^[A-Za-z]:")
        & ~F.exists(segments, lambda part: part.isin("", ".", ".."))
    )


def encode_identity(*names: Column | str) -> Column:
    """Join logical names by `.`, escaping `.` and the escape character inside them."""

    def part(name: Column | str) -> Column:
        escaped = F.replace(column(name), F.lit("\\"), F.lit("\\\\"))
        return F.replace(escaped, F.lit("."), F.lit("\\."))

    return F.concat_ws(".", *[part(name) for name in names])


def decode_identity(value: Column | str) -> Column:
    """Array of logical names; null when the text is not a valid identity.

    NUL may not occur in an identity, so escaped characters are parked behind it while the
    text is split. Names of any length are fine: no backtracking pattern is involved.
    """
    text = column(value)
    parked = F.replace(
        F.replace(text, F.lit("\\\\"), F.lit("\x00b")), F.lit("\\."), F.lit("\x00d")
    )
    names = F.transform(
        F.split(parked, r"\."),
        lambda part: F.replace(
            F.replace(part, F.lit("\x00d"), F.lit(".")), F.lit("\x00b"), F.lit("\\")
        ),
    )
    valid = ~F.contains(text, F.lit("\x00")) & ~F.contains(parked, F.lit("\\"))
    return F.when(valid & ~F.exists(names, lambda name: name == ""), names)


def identity_part(value: Column | str, position: int) -> Column:
    """One logical name of a valid identity, 1-based; plain identities skip the decoder."""
    text = column(value)
    plain = F.split_part(text, F.lit("."), F.lit(position))
    return F.when(F.contains(text, F.lit("\\")), F.element_at(decode_identity(text), position)).otherwise(
        plain
    )


def frame_texts(*components: Column | str) -> Column:
    """`frame_components` for text components only, in one JSON call."""
    return F.to_json(F.array(*[column(c) for c in components]), {"ignoreNullFields": "false"})


def frame_components(*components: Column | str) -> Column:
    """Compact JSON array of text, number or text-list components."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_text(c) for c in components]), F.lit("]"))


def unframe_components(value: Column | str) -> Column:
    """Components of a framed identity as text; null when the text is no JSON array."""
    return F.from_json(column(value), "array<string>")


def json_text(value: Column | str) -> Column:
    """The JSON form of one text or list value."""
    wrapped = F.to_json(F.struct(column(value).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def canonical_json(*names: str) -> Column:
    """JSON object with fields in alphabetical order, nulls kept."""
    ordered = [F.col(name) for name in sorted(names)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def canonical_hash(*names: str) -> Column:
    return sha256_text(canonical_json(*names))


def rfc3339(moment: Column | str) -> Column:
    """UTC text with six fraction digits and `Z`."""
    return F.date_format(column(moment), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def table_id(schema: Column | str, name: Column | str) -> Column:
    return encode_identity(schema, name)


def node_id(kind: Column | str, key: Column | str) -> Column:
    """`kind:key`, null when it would not be a valid node id."""
    text = F.concat(column(kind), F.lit(":"), column(key))
    return F.when(column(kind).rlike(NODE_KIND_PATTERN) & text.rlike(NODE_ID_PATTERN), text)


def node_parts(value: Column | str) -> Column:
    """Kind and key, split on the first colon."""
    text = column(value)
    at = F.instr(text, ":")
    valid = (at > 1) & (at < F.length(text))
    return F.when(
        valid,
        F.struct(
            F.substring(text, F.lit(1), at - 1).alias("kind"),
            F.substring(text, at + 1, F.length(text)).alias("key"),
        ),
    )


def operation_id(kind: str, node: Column | str, phase: Column | str) -> Column:
    """`kind::["node","phase"]`."""
    return F.concat(F.lit(f"{kind}::"), frame_components(node, phase))


def proof_id(recommendation: Column | str, manifest_hash: Column | str) -> Column:
    """`recommendation@sha256:...`, null when it would not be a valid proof id."""
    text = F.concat(column(recommendation), F.lit("@"), column(manifest_hash))
    return F.when(text.rlike(PROOF_ID_PATTERN), text)


def finding_identity(rule: Column | str, objects: Column | str) -> Column:
    """Rule plus sorted distinct objects; the wording of a finding plays no part."""
    return frame_components(rule, F.array_sort(F.array_distinct(column(objects))))
