"""Recorded query plans: one row per node, a fingerprint and a readable shape per document.

A plan document is a recursive JSON tree that no fixed Spark schema covers. It is parsed once to a
VARIANT and cast to structs nested so deep as `LEVELS`; a fold builds its answer from the lowest level
up. All of it is one expression over one row: no shuffle, no Python. What does not parse that way, or is deeper than `LEVELS`, is found by
its missing answer and decoded apart, if there is any.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fleetlens.plans.partitions import spread
from fleetlens.sources.scratch import materialize

#: Levels of a tree that the fold looks at.
LEVELS = 12

# Plan fields that identify a plan, and diagnostic fields that do not.
IDENTITY_FIELDS = {
    "strategy": "Strategy",
    "relation_name": "Relation Name",
    "index_name": "Index Name",
    "join_type": "Join Type",
    "scan_direction": "Scan Direction",
}
KEY_FIELDS = {"sort_key": "Sort Key", "group_key": "Group Key"}
COUNT_FIELDS = {
    "shared_hit_blocks": "Shared Hit Blocks",
    "shared_read_blocks": "Shared Read Blocks",
    "shared_dirtied_blocks": "Shared Dirtied Blocks",
    "shared_written_blocks": "Shared Written Blocks",
    "local_hit_blocks": "Local Hit Blocks",
    "local_read_blocks": "Local Read Blocks",
    "local_dirtied_blocks": "Local Dirtied Blocks",
    "local_written_blocks": "Local Written Blocks",
    "temp_read_blocks": "Temp Read Blocks",
    "temp_written_blocks": "Temp Written Blocks",
    "wal_records": "WAL Records",
    "wal_full_page_images": "WAL FPI",
    "wal_bytes": "WAL Bytes",
}
NUMBER_FIELDS = {"plan_rows": "Plan Rows", "actual_rows": "Actual Rows", "total_cost": "Total Cost"}

_TEXTS = {"node_type": "Node Type", **IDENTITY_FIELDS}
#: The order in which a node's own fields are written after its children.
_LABEL = sorted([*_TEXTS, *KEY_FIELDS])

Make = Callable[..., Column]


def _fold(documents: DataFrame, text: str, kinds: dict[str, str], make: Make, name: str) -> DataFrame:
    """`documents` with `name`: `make` of the root, which folds its children as it needs them.

    `make` gets a node as a struct of the fields `kinds`, the array of its children (None at
    `LEVELS`), what folds a child, the level and what its parent passed on. The result is null where
    there is no plan, or one with more levels. The document is cast once to structs nested `LEVELS`
    deep, and the fold is one expression nested the same way, which goes only where nodes are: a
    column for each level would be copied with each of the others.
    """
    fields = ", ".join(f"`{field}`: {kind}" for field, kind in kinds.items())
    kind = f"struct<{fields}, `Plans`: array<variant>>"
    for _ in range(LEVELS):
        kind = f"struct<{fields}, `Plans`: array<{kind}>>"

    def deeper(node: Column, level: int) -> Column:
        if level == LEVELS:
            return F.coalesce(F.size(node["Plans"]), F.lit(0)) > 0
        return F.exists(node["Plans"], lambda n: deeper(n, level + 1))

    def made(node: Column, level: int, *place: Column) -> Column:
        plans = F.coalesce(node["Plans"], F.array()) if level < LEVELS else None
        return make(node, plans, lambda n, *its: made(n, level + 1, *its), level, *place)

    root = F.col("_root")
    usable = root["Node Type"].isNotNull() & ~F.coalesce(deeper(root, 0), F.lit(False))
    df = documents.withColumn("_root", F.try_variant_get(F.try_parse_json(F.col(text)), "$[0].Plan", kind))
    return df.withColumn(name, F.when(usable, made(root, 0)))


def _answers(
    documents: DataFrame,
    keys: list[str],
    text: str,
    name: str,
    kinds: dict[str, str],
    make: Make,
    by_hand: Callable[[list[dict]], object],
) -> DataFrame:
    """(keys, `name`): the fold of each document, or `by_hand` of its nodes where that is null."""
    folded = _fold(spread(documents.select(*keys, F.col(text).alias("_text"))), "_text", kinds, make, name)
    made = materialize(folded.select(*keys, F.when(F.col(name).isNull(), F.col("_text")).alias("_text"), name), "plans")
    kind: DataType = made.schema[name].dataType
    answered, rest = made.where("_text IS NULL").drop("_text"), made.where("_text IS NOT NULL")
    if rest.isEmpty():
        return answered
    key_types = ", ".join(f"{k} {t}" for k, t in made.select(*keys).dtypes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = (_root(value) for value in batch.column("_text").to_pylist())
            answers = [json.dumps(by_hand(_nodes(plan))) if plan else None for plan in plans]
            columns = [*(batch.column(k) for k in keys), pa.array(answers, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "answer"])

    decoded = rest.select(*keys, "_text").mapInArrow(decode, f"{key_types}, answer string")
    answer = F.get(F.from_json(F.concat(F.lit("["), "answer", F.lit("]")), f"array<{kind.simpleString()}>"), F.lit(0))
    return answered.unionByName(decoded.select(*keys, answer.alias(name)))


def _root(text: str) -> dict | None:
    try:
        document = json.loads(text)
    except (ValueError, RecursionError):
        return None
    first = document[0] if isinstance(document, list) and document else None
    plan = first.get("Plan") if isinstance(first, dict) else None
    return plan if isinstance(plan, dict) and plan.get("Node Type") is not None else None


def _written(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _plain(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else _written(value)


def _nodes(plan: dict) -> list[dict]:
    """Rows of the nodes in pre-order, with how far up the parent stands and how many are below."""
    found: list[dict] = []
    stack: list[tuple[dict, int, int]] = [(plan, -1, 0)]
    while stack:
        node, parent, depth = stack.pop()
        row = {name: _plain(node.get(field)) for name, field in _TEXTS.items()}
        row |= {name: _written(node.get(field) or []) for name, field in KEY_FIELDS.items()}
        row |= {name: node.get(field) for name, field in NUMBER_FIELDS.items()}
        blocks, wal = (any(f in node for f in group) for group in _COUNT_GROUPS)
        for name, field in COUNT_FIELDS.items():
            row[name] = node.get(field, 0) if (blocks if name.endswith("blocks") else wal) else None
        row |= {"depth": depth, "up": len(found) - parent if found else None, "below": 0}
        found.append(row)
        stack.extend((child, len(found) - 1, depth + 1) for child in reversed(node.get("Plans") or []))
    for i in range(len(found) - 1, 0, -1):
        found[i - found[i]["up"]]["below"] += found[i]["below"] + 1
    return found


def _joined(nodes: list[dict], own: Callable[[dict, str], str], between: str) -> str:
    """A text built from the last node to the first: `own` of a node and of its children's texts."""
    texts: list[list[str]] = [[] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        text = own(nodes[i], between.join(reversed(texts[i])))
        texts[i] = []
        if i == 0:
            return text
        texts[i - nodes[i]["up"]].append(text)
    return ""


_COUNT_GROUPS = (
    [field for name, field in COUNT_FIELDS.items() if name.endswith("blocks")],
    ["WAL Records", "WAL Bytes"],
)


def _list(node: Column, field: str) -> Column:
    """A list field; one that is missing or null is empty."""
    return F.when(F.is_variant_null(node[field]), None).otherwise(node[field])


def flatten_plans(documents: DataFrame, keys: list[str], text: str = "doc") -> DataFrame:
    """One row per plan node: position, parent, depth, identity and diagnostic fields."""

    def own(node: Column, level: int, up: Column) -> Column:
        columns = [F.lit(level).alias("depth")]
        columns += [node[field].alias(name) for name, field in _TEXTS.items()]
        columns += [F.coalesce(F.to_json(_list(node, field)), F.lit("[]")).alias(name) for name, field in KEY_FIELDS.items()]
        columns += [node[field].alias(name) for name, field in NUMBER_FIELDS.items()]
        columns += [node[field].alias(name) for name, field in COUNT_FIELDS.items()]
        return F.struct(*columns, up.alias("up"))

    def make(
        node: Column, plans: Column | None, made: Callable[..., Column], level: int, up: Column | None = None
    ) -> Column:
        row = F.array(own(node, level, F.lit(None).cast("int") if up is None else up))
        if plans is None:
            return row
        # A child stands as many rows behind its parent as have been put together before it.
        return F.aggregate(plans, row, lambda rows, n: F.concat(rows, made(n, F.size(rows))))

    kinds = dict.fromkeys(_TEXTS.values(), "string") | dict.fromkeys(KEY_FIELDS.values(), "variant")
    kinds |= dict.fromkeys(NUMBER_FIELDS.values(), "double") | dict.fromkeys(COUNT_FIELDS.values(), "bigint")
    rows = _answers(documents, keys, text, "rows", kinds, make, lambda nodes: nodes)
    out = rows.select(*keys, F.posexplode("rows").alias("node", "_row")).select(*keys, "node", "_row.*")
    # A count that is missing beside others of its group is 0; asked of rows, since in the fold every
    # count would look through its group again.
    named = {field: name for name, field in COUNT_FIELDS.items()}
    blocks, wal = (F.coalesce(*(named[field] for field in group)).isNotNull() for group in _COUNT_GROUPS)
    counts = {
        name: F.when(blocks if name.endswith("blocks") else wal, F.coalesce(name, F.lit(0).cast("bigint")))
        for name in COUNT_FIELDS
    }
    out = out.withColumns(counts)
    parent = (F.col("node") - F.col("up")).alias("parent")
    rest = [c for c in out.columns if c not in (*keys, "node", "up", "depth")]
    return out.select(*keys, "node", parent, "depth", *rest)


def plan_fingerprints(documents: DataFrame, keys: list[str], text: str = "doc") -> DataFrame:
    """(keys, plan_fingerprint); null for an unusable document.

    The fingerprint covers node kinds, relations, indexes, joins, directions, keys and the
    tree itself; costs, row counts and filter text play no part.
    """

    def make(node: Column, plans: Column | None, made: Callable[..., Column], level: int) -> Column:
        empty = F.parse_json(F.lit("[]"))
        values = [
            F.coalesce(_list(node, KEY_FIELDS[n]), empty) if n in KEY_FIELDS else node[_TEXTS[n]] for n in _LABEL
        ]
        label = F.to_json(F.struct(*(v.alias(n) for n, v in zip(_LABEL, values, strict=True))), {"ignoreNullFields": "false"})
        return F.concat(F.lit('{"children":['), _texts_of(plans, made, ","), F.lit("],"), F.substr(label, F.lit(2)))

    def own(row: dict, below: str) -> str:
        label = "".join(f',"{n}":{row[n] if n in KEY_FIELDS else _written(row[n])}' for n in _LABEL)
        return f'{{"children":[{below}]{label}}}'

    kinds = dict.fromkeys([*_TEXTS.values(), *KEY_FIELDS.values()], "variant")
    canonical = _answers(documents, keys, text, "canonical", kinds, make, lambda nodes: _joined(nodes, own, ","))
    return canonical.select(*keys, F.concat(F.lit("sha256:"), F.sha2("canonical", 256)).alias("plan_fingerprint"))


def _texts_of(plans: Column | None, made: Callable[..., Column], between: str) -> Column:
    return F.lit("") if plans is None else F.array_join(F.transform(plans, lambda n: made(n)), between)


def plan_shapes(documents: DataFrame, keys: list[str], text: str = "doc") -> DataFrame:
    """(keys, normalized_shape): the readable form of what the fingerprint covers."""

    def make(node: Column, plans: Column | None, made: Callable[..., Column], level: int) -> Column:
        def given(name: str) -> Column:
            return F.nullif(node[_TEXTS[name]], F.lit(""))

        place = F.coalesce(
            F.concat(F.lit("using "), given("index_name")), F.concat(F.lit("on "), given("relation_name"))
        )
        strategy = F.concat(F.lit("("), given("strategy"), F.lit(")"))
        words = F.concat_ws(" ", given("join_type"), given("node_type"), strategy, place)
        if plans is None:
            return words
        inner = F.concat(F.lit(" -> ("), _texts_of(plans, made, ", "), F.lit(")"))
        return F.concat(words, F.when(F.size(plans) == 0, "").otherwise(inner))

    def own(row: dict, below: str) -> str:
        place = f"using {row['index_name']}" if row["index_name"] else row["relation_name"] and f"on {row['relation_name']}"
        strategy = row["strategy"] and f"({row['strategy']})"
        words = " ".join(w for w in (row["join_type"], row["node_type"], strategy, place) if w)
        return f"{words} -> ({below})" if row["below"] else words

    kinds = dict.fromkeys(_TEXTS.values(), "string")
    return _answers(documents, keys, text, "normalized_shape", kinds, make, lambda nodes: _joined(nodes, own, ", "))
