"""File inventories of many checkouts, and the framework signals in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.identity import sha256_text
from fleetlens.plans.ordering import running_total
from fleetlens.sources.scratch import materialize

# Limits in bytes, folder names and file endings that are left out. A tool's own
# work folder is passed by the caller.
MAX_FILE_BYTES = 2_000_000
MAX_TOTAL_BYTES = 200_000_000
EXCLUDED_FOLDERS = [
    ".git",
    ".hg",
    ".svn",
    "__pycache__",
    ".venv",
    "venv",
    "node_modules",
    ".mypy_cache",
    ".pytest_cache",
    ".ruff_cache",
    ".tox",
    ".eggs",
    "dist",
    "build",
    ".idea",
    ".vscode",
]
EXCLUDED_SUFFIXES = [".pyc", ".pyo", ".so"]
DOCKER_FILES = [
    "Dockerfile",
    "docker-compose.yml",
    "docker-compose.yaml",
    "compose.yml",
    "compose.yaml",
]


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(app_id, path, size, content, content_hash) of every file below `root/<app_id>/`."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    )
    inside = F.split_part("path", F.lit(root.rstrip("/") + "/"), F.lit(-1))
    return files.select(
        F.substring_index(inside, "/", 1).alias("app_id"),
        F.regexp_replace(inside, "^[^/]+/", "").alias("path"),
        F.col("length").alias("size"),
        "content",
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"),
    )


def exclusion_reason(path: Column | str, work_folders: Sequence[str] = ()) -> Column:
    """Why a path is never read, else null; the outermost excluded folder is named."""
    excluded = [*EXCLUDED_FOLDERS, *work_folders]
    text = F.col(path) if isinstance(path, str) else path
    parts = F.split(text, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    name = F.element_at(parts, -1)
    bad = F.get(
        F.filter(folders, lambda f: f.isin(excluded) | f.endswith(".egg-info")), F.lit(0)
    )
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    return (
        F.when(bad.isNotNull(), F.concat(F.lit("excluded: "), bad, F.lit("/")))
        .when(name.startswith(".env"), F.concat(F.lit("excluded: "), name))
        .when(suffix.isin(EXCLUDED_SUFFIXES), F.concat(F.lit("excluded: "), suffix, F.lit(" file")))
    )


def file_inventory(
    files: DataFrame,
    max_file: int = MAX_FILE_BYTES,
    max_total: int = MAX_TOTAL_BYTES,
    work_folders: Sequence[str] = (),
) -> DataFrame:
    """(app_id, path, size, reason): reason is null for files taken in.

    Files are taken in path order while the app's total stays within `max_total`; one that does
    not fit is skipped and later smaller ones may still be taken. What is left of the budget lies
    between a power of two and its double: every file below that power fits, of those from it on at
    most one can be taken, and either way the rest falls below the power in the end. One running total
    of the small files tells where, so the rounds are as many as the budget has binary digits,
    however many files are skipped.
    """
    reason = F.coalesce(
        exclusion_reason("path", work_folders),
        F.when(
            F.col("size") > max_file,
            F.concat(F.lit("file too large ("), F.col("size"), F.lit(f" bytes, limit {max_file})")),
        ),
    )
    judged = files.select("app_id", "path", "size", reason.alias("reason"))
    candidates = judged.where("reason IS NULL").select(
        "app_id", "path", "size", F.lit(max_total).cast("long").alias("budget")
    )
    taken: list[DataFrame] = []
    power = F.expr("shiftleft(1L, length(bin(greatest(budget, 1L))) - 1)")
    while not candidates.isEmpty():
        parted = candidates.withColumn("power", power).withColumn(
            "small", F.when(F.col("size") < F.col("power"), F.col("size")).otherwise(0)
        )
        totals = materialize(running_total(parted, ["app_id"], ["path"], "total", weight=F.col("small")), "totals")
        is_small = F.col("size") < F.col("power")
        # A small file always fits; a larger one takes the rest below the power, as small ones do in the end.
        ends = F.when(is_small, F.col("total") > F.greatest(F.col("budget") - F.col("power"), F.lit(0))).otherwise(
            F.col("size") <= F.col("budget") - F.col("total")
        )
        first = totals.where(ends).groupBy("app_id").agg(F.min("path").alias("stop"))
        marked = totals.join(first, "app_id", "left")
        last = F.col("path") == F.col("stop")
        fits = marked.where((is_small & (F.col("stop").isNull() | (F.col("path") <= F.col("stop")))) | last)
        taken.append(fits.select("app_id", "path"))
        spent = marked.where(last).select("app_id", (F.col("total") + F.when(is_small, 0).otherwise(F.col("size"))).alias("spent"))
        candidates = materialize(
            marked.where(F.col("path") > F.col("stop"))
            .join(spent, "app_id")
            .withColumn("budget", F.col("budget") - F.col("spent"))
            .where(F.col("size") <= F.col("budget"))
            .select("app_id", "path", "size", "budget"),
            "candidates",
        )
    kept = None
    for part in taken:
        kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        kept = judged.select("app_id", "path").where("false")
    over = F.when(F.col("reason").isNull() & F.col("kept").isNull(), "total size limit reached")
    return judged.join(kept.withColumn("kept", F.lit(True)), ["app_id", "path"], "left").select(
        "app_id", "path", "size", F.coalesce("reason", over).alias("reason")
    )


def import_roots(source: Column | str) -> Column:
    """Distinct top-level module names imported by a Python text, line by line."""
    text = F.col(source) if isinstance(source, str) else source
    plain = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*import[ \t]+([^#;\n]+)"), F.lit(1))
    names = F.flatten(F.transform(plain, lambda line: F.split(line, ",")))
    roots = F.transform(names, lambda n: F.regexp_extract(n, r"^\s*([A-Za-z_]\w*)", 1))
    origin = F.regexp_extract_all(
        text, F.lit(r"(?m)^[ \t]*from[ \t]+([A-Za-z_]\w*)[\w.]*[ \t]+import\b"), F.lit(1)
    )
    return F.array_distinct(F.filter(F.concat(roots, origin), lambda r: r != ""))


def framework_signals(files: DataFrame) -> DataFrame:
    """One row per app from the paths and sources (app_id, path, source) of the files taken in.

    The lists hold folder and package names, not files.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    depth = F.size(parts)
    package = name == "__init__.py"
    folder = F.when(depth > 1, F.array_join(F.slice(parts, 1, depth - 1), "/")).otherwise(".")
    facts = files.select(
        "app_id",
        "path",
        name.alias("name"),
        parts.alias("parts"),
        folder.alias("folder"),
        F.when(package & (depth == 2), F.get(parts, F.lit(0)))
        .when(package & (depth == 3) & (F.get(parts, F.lit(0)) == "src"), F.get(parts, F.lit(1)))
        .alias("package"),
        F.when(name.endswith(".py"), import_roots("source"))
        .otherwise(F.array().cast("array<string>"))
        .alias("roots"),
    )
    versions = (
        facts.where(F.col("folder").rlike("(^|/)versions$"))
        .select("app_id", F.regexp_replace("folder", "/?versions$", "").alias("folder"))
        .distinct()
    )
    environments = (
        facts.where("name = 'env.py'")
        .select("app_id", "folder")
        .join(versions, ["app_id", "folder"], "left_semi")
        .groupBy("app_id")
        .agg(F.array_sort(F.collect_set("folder")).alias("alembic_directories"))
    )
    project = r'(?s)(?:^|\n)\[project\][^\[]*?\n[ \t]*name[ \t]*=[ \t]*"([^"\n]+)"'
    named = F.regexp_extract("source", project, 1)
    packages = files.where("path = 'pyproject.toml'").select(
        "app_id", F.when(named != "", named).alias("package_name")
    )
    flags = facts.groupBy("app_id").agg(
        F.bool_or(F.col("name") == "alembic.ini").alias("_ini"),
        F.bool_or(F.array_contains("roots", "sqlalchemy")).alias("uses_sqlalchemy"),
        F.bool_or(F.array_contains("roots", "sqlmodel")).alias("uses_sqlmodel"),
        F.bool_or(
            F.col("name").startswith("test_")
            | F.col("name").endswith("_test.py")
            | F.array_contains("parts", "tests")
        ).alias("has_tests"),
        F.array_sort(F.collect_set(F.when(F.col("name").isin(DOCKER_FILES), F.col("path")))).alias("docker_files"),
        F.array_sort(F.collect_set("package")).alias("likely_app_roots"),
    )
    return (
        flags.join(environments, "app_id", "left")
        .join(packages, "app_id", "left")
        .withColumn("uses_alembic", F.col("alembic_directories").isNotNull() | F.col("_ini"))
        .withColumn(
            "alembic_directories",
            F.coalesce("alembic_directories", F.array().cast("array<string>")),
        )
        .drop("_ini")
    )


def text_hash(files: DataFrame) -> DataFrame:
    """Add content_hash of a text column `source`."""
    return files.withColumn("content_hash", sha256_text("source"))
