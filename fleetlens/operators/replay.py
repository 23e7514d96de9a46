"""Schema state after a migration history, as set operations over the operation log.

`operations` holds app_id, pos (a whole number, unique inside the app, in replay order),
revision, kind, table_name, object_name, new_name, columns, ref_table, nullable, new_type,
server_default, primary_key. The columns inside a create arrive as `create_column` rows at the
position of their create.

Tables, and columns inside a table, are names with a lifetime: an operation starts a name, ends
it, or renames it. Everything else asks which lifetime holds a name at a position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.identity import encode_identity, table_id
from fleetlens.plans.graphs import shuffled
from fleetlens.plans.ordering import carry_forward, piece_width
from fleetlens.sources.scratch import materialize

APP = ["app_id"]
#: Stands for the place before all positions of a name.
_BEFORE = -(1 << 63)


@dataclass(frozen=True)
class Lifetimes:
    """Named objects of one kind.

    `marks` (keys, name, pos, alive, first_name, first_pos) are all starts and ends that took
    effect, with the first start of the lifetime that a start begins or continues; `final` (keys,
    name, first_name, first_pos) are the lifetimes open at the end. `width` is that of ordered
    pieces, null where no key needs any.
    """

    keys: list[str]
    marks: DataFrame
    final: DataFrame
    width: int | None

    def holders(self, lookups: DataFrame, after: bool) -> DataFrame:
        """Add first_name and first_pos of the lifetime holding `name` at `pos`, else null.

        `after` sees the starts and ends of the same position, otherwise only earlier ones.
        """
        on = [*self.keys, "name"]
        fields = [c for c in lookups.columns if c not in on]
        asked = _named(lookups, on).select(
            *on,
            (F.col("pos") * 2 + (1 if after else -1)).alias("slot"),
            F.struct(*fields).alias("row"),
        )
        marks = self.marks.select(
            *on,
            (F.col("pos") * 2).alias("slot"),
            F.struct("first_name", "first_pos").alias("mark"),
        )
        carried = carry_forward(
            marks.unionByName(asked, allowMissingColumns=True),
            on,
            "slot",
            F.col("mark"),
            "held",
            self.width and 2 * self.width,
        )
        return carried.where("row IS NOT NULL").select(*on, "row.*", "held.*")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that can be placed: those without keys or position belong to no name."""
    return rows.dropna(subset=[*keys, "pos"])


def _links(fixed: DataFrame, renames: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """(keys, pos, old_name, new_name, base, old_from, new_from): a row for each rename.

    A drop, a create and a rename away settle whether a name is alive, a rename to it does not
    unless it takes effect. `old_from` and `new_from` are where the old and the new name were last
    settled before the rename; `base` is `old_from` where that was a create.
    """
    pair = ["old_name", "new_name"]
    ways = renames.select(
        *keys,
        "pos",
        F.inline(
            F.array(
                F.struct(F.col("old_name").alias("name"), F.lit(False).alias("alive"), F.lit(None).cast("string").alias("old_name"), F.col("new_name")),
                F.struct(F.col("new_name").alias("name"), F.lit(None).cast("boolean").alias("alive"), F.col("old_name"), F.lit(None).cast("string").alias("new_name")),
            )
        ),
    )
    settled = F.when(F.col("alive").isNotNull(), F.struct("alive", F.col("pos").alias("at")))
    carried = carry_forward(
        fixed.unionByName(ways, allowMissingColumns=True), [*keys, "name"], "pos", settled, "held", width
    )
    since = F.coalesce("held.at", F.lit(_BEFORE))
    away = F.col("alive").isNotNull()
    # A rename that is logged twice finds its own end before it the second time.
    first = away & (since < F.col("pos"))
    return (
        carried.where("old_name IS NOT NULL OR new_name IS NOT NULL")
        .withColumn("base", F.when(first & F.col("held.alive"), F.col("held.at")))
        .withColumn("old_from", F.when(first, since))
        .withColumn("new_from", F.when(~away, since))
        .groupBy(*keys, "pos", F.coalesce("old_name", "name").alias("old_name"), F.coalesce("new_name", "name").alias("new_name"))
        .agg(*[F.max(c).alias(c) for c in ("base", "old_from", "new_from")])
        .select(*keys, "pos", *pair, "base", "old_from", "new_from")
    )


def _effective(links: DataFrame, keys: list[str]) -> DataFrame:
    """The renames whose old name is alive, with `held_pos`, the start they continue.

    A stretch is a name from where it is settled to where it is settled next, so one rename at most
    leaves it. A stretch that does not begin with a create is alive at its end if a rename that took
    effect leads to it; that is handed on along the stretches by jumps of doubling length.
    """
    links = materialize(links, "renames")
    source = F.struct(F.col("old_name").alias("name"), F.col("old_from").alias("at"))
    target = F.struct(F.col("new_name").alias("name"), F.col("new_from").alias("at"))
    state = links.where("base IS NULL").select(*keys, source.alias("id"), target.alias("next"))
    lit = links.where("base IS NOT NULL").select(*keys, target.alias("id")).distinct()
    state = _handed(state.withColumn("alive", F.lit(False)), lit, keys)
    while not state.where("alive AND next IS NOT NULL").isEmpty():
        lit = state.where("alive AND next IS NOT NULL").select(*keys, F.col("next").alias("id")).distinct()
        jump = state.select(*keys, F.col("id").alias("next"), F.col("next").alias("further"))
        jumped = state.join(shuffled(jump), [*keys, "next"], "left").select(
            *keys, "id", F.col("further").alias("next"), "alive"
        )
        state = _handed(jumped, lit, keys)
    alive = state.where("alive").select(*keys, F.col("id.name").alias("old_name"), F.col("id.at").alias("old_from"), F.lit(True).alias("alive"))
    took = materialize(
        links.join(shuffled(alive), [*keys, "old_name", "old_from"], "left")
        .where("base IS NOT NULL OR alive")
        .drop("alive"),
        "renames",
    )
    led = took.groupBy(*keys, F.col("new_name").alias("old_name"), F.col("new_from").alias("old_from")).agg(
        F.max("pos").alias("led")
    )
    return took.join(shuffled(led), [*keys, "old_name", "old_from"], "left").select(
        *keys, "pos", "old_name", "new_name", F.coalesce("led", "base").alias("held_pos"), F.col("led").isNotNull().alias("open")
    )


def _handed(state: DataFrame, lit: DataFrame, keys: list[str]) -> DataFrame:
    """`state` with the stretches `lit` alive."""
    lit = lit.withColumn("lit", F.lit(True))
    return materialize(
        state.join(shuffled(lit), [*keys, "id"], "left").select(
            *keys, "id", "next", F.coalesce(F.col("alive") | F.col("lit"), "alive").alias("alive")
        ),
        "stretches",
    )


def _origins(took: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, old_name, new_name, first_name, first_pos): each rename's lifetime led back to its
    first start, by pointer doubling. `open` are those that continue another rename."""
    columns = [*keys, "pos", "old_name", "new_name", "root", "open"]
    root = F.struct(F.col("old_name").alias("name"), F.col("held_pos").alias("pos"))
    state = materialize(took.withColumn("root", root).select(*columns), "origins")
    while not state.where("open").isEmpty():
        jump = state.select(
            *keys,
            F.struct(F.col("new_name").alias("name"), "pos").alias("root"),
            F.col("root").alias("further"),
            F.col("open").alias("onward"),
        ).dropDuplicates([*keys, "root"])
        moved = state.where("open").join(shuffled(jump), [*keys, "root"])
        moved = moved.withColumn("root", F.col("further")).withColumn("open", F.col("onward")).select(*columns)
        state = materialize(state.where("NOT open").unionByName(moved), "origins")
    return state.select(
        *keys, "pos", "old_name", "new_name", F.col("root.name").alias("first_name"), F.col("root.pos").alias("first_pos")
    )


def lifetimes(
    starts: DataFrame, ends: DataFrame, renames: DataFrame, keys: list[str], width: int | None
) -> Lifetimes:
    """`starts` and `ends` hold (keys, name, pos), `renames` (keys, pos, old_name, new_name)."""
    fixed = _named(
        starts.select(*keys, "pos", "name", F.lit(True).alias("alive")).unionByName(
            ends.select(*keys, "pos", "name", F.lit(False).alias("alive"))
        ),
        [*keys, "name"],
    )
    links = _links(fixed, _named(renames, [*keys, "old_name", "new_name"]), keys, width)
    took = _origins(_effective(links, keys), keys)
    pair = F.array(
        F.struct(F.col("new_name").alias("name"), F.lit(True).alias("alive"), "first_name", "first_pos"),
        F.struct(
            F.col("old_name").alias("name"),
            F.lit(False).alias("alive"),
            F.lit(None).cast("string").alias("first_name"),
            F.lit(None).cast("long").alias("first_pos"),
        ),
    )
    marks = fixed.select(
        *keys, "pos", "name", "alive", F.expr("IF(alive, name, NULL) AS first_name"), F.expr("IF(alive, pos, NULL) AS first_pos")
    ).unionByName(took.select(*keys, "pos", F.inline(pair)))
    last = marks.groupBy(*keys, "name").agg(
        F.max(F.struct("pos", "alive", "first_name", "first_pos")).alias("last")
    )
    final = last.where("last.alive").select(*keys, "name", "last.first_name", "last.first_pos")
    return Lifetimes(keys, marks, final, width)


def table_lifetimes(operations: DataFrame, width: int | None = None) -> Lifetimes:
    """The tables of a log; `width` of ordered pieces is measured where none is given."""
    width = width or piece_width(operations, APP, "pos")

    def named(kind: str) -> DataFrame:
        return operations.where(F.col("kind") == kind).select(
            "app_id", F.col("table_name").alias("name"), "pos"
        )

    # Renaming a table to its own name changes nothing.
    renames = operations.where("kind = 'rename_table' AND new_name <> table_name").select(
        "app_id", "pos", F.col("table_name").alias("old_name"), "new_name"
    )
    return lifetimes(named("create_table"), named("drop_table"), renames, APP, width)


def replay_tables(tables: Lifetimes) -> DataFrame:
    """(app_id, table_name, first_name, first_pos): tables left after all operations."""
    return tables.final.select(
        "app_id", F.col("name").alias("table_name"), "first_name", "first_pos"
    )


_COLUMN_KINDS = ["create_column", "add_column", "drop_column", "alter_column"]


def _attached(operations: DataFrame, tables: Lifetimes, fields: list[str]) -> DataFrame:
    """Column operations, with the first start of the table (`name`) they meet."""
    asked = operations.where(F.col("kind").isin(_COLUMN_KINDS))
    return tables.holders(asked.select("app_id", F.col("table_name").alias("name"), "pos", *fields), after=True)


def unknown_table_operations(operations: DataFrame, tables: Lifetimes) -> DataFrame:
    """Columns added to a table that does not exist at that point."""
    return (
        _attached(operations.where("kind = 'add_column'"), tables, [])
        .where("first_pos IS NULL")
        .select(
            "app_id",
            "pos",
            F.concat(F.lit("add_column on unknown table '"), "name", F.lit("'")).alias("reason"),
        )
    )


def replay_columns(operations: DataFrame, tables: Lifetimes) -> DataFrame:
    """Columns of the tables left after all operations, the last writer winning.

    A renamed table keeps its old name inside the ids of columns written before the rename.
    """
    keys = ["app_id", "table_pos"]
    written = ["nullable", "new_type", "server_default"]
    left = materialize(
        replay_tables(tables).select(
            "app_id", F.col("first_pos").alias("table_pos"), F.col("table_name").alias("left_name")
        ),
        "tables-left",
    )
    # Columns of tables that are gone are not asked for.
    known = materialize(
        _attached(operations, tables, ["kind", "object_name", "new_name", *written])
        .where("first_pos IS NOT NULL")
        .withColumnRenamed("first_pos", "table_pos")
        .join(left, keys, "left_semi")
        .select(*keys, "pos", F.col("name").alias("table_name"), "kind", F.col("object_name").alias("name"), "new_name", *written),
        "column-operations",
    )
    defines = known.where("kind IN ('create_column', 'add_column')")
    renames = known.where(
        "kind = 'alter_column' AND new_name IS NOT NULL AND new_name <> name"
    ).select(*keys, "pos", F.col("name").alias("old_name"), "new_name")
    columns = lifetimes(
        defines.select(*keys, "name", "pos"),
        known.where("kind = 'drop_column'").select(*keys, "name", "pos"),
        renames,
        keys,
        tables.width,
    )
    written = ["pos", "table_name", *written]
    alters = (
        columns.holders(known.where("kind = 'alter_column'").select(*keys, "name", *written), after=False)
        .where("first_pos IS NOT NULL")
        .select(*keys, "first_name", "first_pos", *written)
    )
    writes = defines.select(
        *keys, F.col("name").alias("first_name"), F.col("pos").alias("first_pos"), *written
    ).unionByName(alters)

    def latest(name: str) -> Column:
        return F.expr(f"max_by({name}, pos) FILTER (WHERE {name} IS NOT NULL)").alias(name)

    first = [*keys, "first_name", "first_pos"]
    facts = (
        writes.join(columns.final, first, "left_semi")
        .groupBy(*first)
        .agg(
            latest("nullable"),
            latest("new_type"),
            latest("server_default"),
            F.max_by("table_name", "pos").alias("id_table"),
        )
    )
    return (
        columns.final.join(facts, first)
        .join(left, keys)
        .select(
            "app_id",
            F.col("left_name").alias("table_name"),
            F.col("name").alias("column_name"),
            encode_identity(F.lit("public"), "id_table", "name").alias("column_id"),
            F.col("new_type").alias("data_type"),
            "nullable",
            F.col("server_default").alias("default_expression"),
        )
    )


def replay_constraints(operations: DataFrame) -> DataFrame:
    """Constraints left after all operations: latest create per name, cut by later drops.

    The key columns a create marks arrive as `create_column` rows; all of them make up the
    key `pk_<table>`.
    """
    ids = F.transform("columns", lambda c: encode_identity(F.lit("public"), "table_name", c))
    kinds = F.create_map(
        *[
            F.lit(x)
            for pair in {
                "create_primary_key": "primary_key",
                "create_foreign_key": "foreign_key",
                "create_unique_constraint": "unique",
                "create_check_constraint": "check",
            }.items()
            for x in pair
        ]
    )
    explicit = operations.where(
        F.col("kind").isin("create_primary_key", "create_foreign_key", "create_unique_constraint", "create_check_constraint")
    ).select(
        "app_id",
        F.col("object_name").alias("name"),
        "pos",
        F.struct(
            F.try_element_at(kinds, F.col("kind")).alias("kind"),
            "table_name",
            F.coalesce(ids, F.array().cast("array<string>")).alias("columns"),
            table_id(F.lit("public"), "ref_table").alias("referenced_table"),
            "revision",
        ).alias("made"),
    )
    implied = (
        operations.where("kind = 'create_column' AND primary_key")
        .groupBy("app_id", "table_name", "pos", "revision")
        .agg(F.array_sort(F.collect_list("object_name")).alias("names"))
        .select(
            "app_id",
            F.concat(F.lit("pk_"), "table_name").alias("name"),
            "pos",
            F.struct(
                F.lit("primary_key").alias("kind"),
                "table_name",
                F.transform(
                    "names", lambda c: encode_identity(F.lit("public"), "table_name", c)
                ).alias("columns"),
                F.lit(None).cast("string").alias("referenced_table"),
                "revision",
            ).alias("made"),
        )
    )
    return _latest_objects(operations, explicit.unionByName(implied), "drop_constraint")


def replay_indexes(operations: DataFrame) -> DataFrame:
    """Indexes left after all operations."""
    ids = F.transform("columns", lambda c: encode_identity(F.lit("public"), "table_name", c))
    made = operations.where("kind = 'create_index'").select(
        "app_id",
        F.col("object_name").alias("name"),
        "pos",
        F.struct("table_name", ids.alias("columns"), "revision").alias("made"),
    )
    return _latest_objects(operations, made, "drop_index")


def _latest_objects(operations: DataFrame, made: DataFrame, drop_kind: str) -> DataFrame:
    latest = made.groupBy("app_id", "name").agg(
        F.max("pos").alias("pos"), F.max_by("made", "pos").alias("made")
    )
    dropped = (
        operations.where(F.col("kind") == drop_kind)
        .groupBy("app_id", F.col("object_name").alias("name"))
        .agg(F.max("pos").alias("dropped_at"))
    )
    gone = (
        operations.where("kind = 'drop_table'")
        .groupBy("app_id", "table_name")
        .agg(F.max("pos").alias("table_dropped_at"))
    )
    never = F.lit(-1).cast("long")
    return (
        latest.select("app_id", "name", "pos", "made.*")
        .join(dropped, ["app_id", "name"], "left")
        .join(gone, ["app_id", "table_name"], "left")
        .where(F.col("pos") > F.coalesce("dropped_at", never))
        .where(F.col("pos") > F.coalesce("table_dropped_at", never))
        .withColumn("table_id", table_id(F.lit("public"), "table_name"))
        .drop("pos", "dropped_at", "table_dropped_at", "table_name")
    )
