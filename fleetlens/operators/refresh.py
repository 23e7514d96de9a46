"""Rule results that are kept, and made anew only for applications whose inputs changed.

Each application has a digest over all its input rows (sums of their hashes) and the rules' versions.
Applications whose digest is not the stored one are evaluated, and their results take the place of
the old ones. Applications share a fixed number of folders, so that the files of a store do not grow in
number with the fleet; a folder with a changed application is written anew, with the rows it keeps.
Digests are stored last, so a refresh that breaks off is done again by the next one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.rules import RULES, Rule, RuleOutput, run_rules
from fleetlens.sources.scratch import materialize

_PARTS = ("findings", "questions", "reasons")
#: The folder column; the application's name stays in the rows, as text.
_FOLDER = "app_group"
_FOLDERS = 64


def app_digests(ctx: Mapping[str, DataFrame], rules: list[Rule] | None = None) -> DataFrame:
    """(app_id, digest) over the rows of every frame of an application and the rules' versions.

    Hashes of rows are added up digit by digit, so that a task sends a row for each application it has
    rows of, and nothing is written. Digests are only compared as a whole; sets that are looked into
    are kept as tries (`plans.tries`).
    """
    frames = []
    for name, df in sorted(ctx.items()):
        fields = []
        for column, kind in sorted(df.drop("app_id").dtypes):
            value = F.col(column)
            fields.append((F.array_sort(F.map_entries(value)) if kind.startswith("map") else value).alias(column))
        text = F.to_json(F.struct(F.lit(name).alias("_frame"), *fields), {"ignoreNullFields": "false"})
        frames.append(df.select("app_id", text.alias("_text")))
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    versions = ",".join(sorted(f"{r.id}@{r.version}" for r in (RULES if rules is None else rules)))
    # Six of the 64 digits at a time: sums of 2^39 rows fit.
    parts = [F.conv(F.substring("_hash", at, 6), 16, 10).cast("bigint") for at in range(1, 65, 6)]
    sums = rows.select("app_id", F.sha2("_text", 256).alias("_hash")).groupBy("app_id").agg(
        F.concat_ws("|", F.count("*"), *(F.sum(part) for part in parts)).alias("_sums")
    )
    return sums.select("app_id", F.sha2(F.concat_ws("|", "_sums", F.lit(versions)), 256).alias("digest"))


def _folder() -> Column:
    return F.pmod(F.xxhash64("app_id"), F.lit(_FOLDERS)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _replace(rows: DataFrame, ids: DataFrame, folders: list[int], path: str) -> None:
    """Write `rows` (app_id, ...) in place of what is stored of the applications `ids`, which are in `folders`."""
    # A mark for each folder, so that one that has no rows any more is replaced too.
    marks = ids.sparkSession.createDataFrame([(f, True) for f in folders], f"{_FOLDER} int, _mark boolean")
    written = rows.withColumns({_FOLDER: _folder(), "_mark": F.lit(False)})
    stored = _stored(ids.sparkSession, path)
    if stored is not None:
        kept = stored.where(F.col(_FOLDER).isin(folders) & ~F.col("_mark"))
        written = written.unionByName(kept.join(ids, "app_id", "left_anti"), allowMissingColumns=True)
    written = written.unionByName(marks, allowMissingColumns=True).hint("rebalance", _FOLDER)
    writer = written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_FOLDER).parquet(path)


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    stored = _stored(spark, path)
    return None if stored is None else stored.where("NOT _mark").drop("_mark", _FOLDER)


def refresh(ctx: Mapping[str, DataFrame], store: str, rules: list[Rule] | None = None) -> DataFrame:
    """Bring the results below `store` up to date; returns (app_id, digest) of what was made anew.

    The digest is null for an application that is gone. `ctx` holds frames with app_id; rows without
    one play no part.
    """
    known = {name: df.where("app_id IS NOT NULL") for name, df in ctx.items()}
    spark = next(iter(known.values())).sparkSession
    now = app_digests(known, rules).withColumnRenamed("digest", "_now")
    before = _rows(spark, f"{store}/digests")
    if before is None:
        before = now.select("app_id", F.col("_now").alias("digest")).where(F.lit(False))
    both = now.join(before, "app_id", "full")
    changed = both.where(~F.col("_now").eqNullSafe(F.col("digest"))).select("app_id", F.col("_now").alias("digest"))
    changed = materialize(changed, "changed-apps")
    if changed.isEmpty():
        return changed
    ids = changed.select("app_id")
    folders = [r[_FOLDER] for r in ids.select(_folder().alias(_FOLDER)).distinct().collect()]
    # A selective filter on this side lets Spark skip partitions of frames that are laid out by app.
    present = changed.where("digest > ''")
    out = run_rules({name: df.join(present.select("app_id"), "app_id", "left_semi") for name, df in known.items()}, rules)
    for part in _PARTS:
        rows = getattr(out, part)
        if rows is not None:
            _replace(rows, ids, folders, f"{store}/{part}")
    _replace(present, ids, folders, f"{store}/digests")
    return changed


def stored_output(spark: SparkSession, store: str) -> RuleOutput:
    """The results below `store`, as `run_rules` gives them."""
    return RuleOutput(*(_rows(spark, f"{store}/{part}") for part in _PARTS))
