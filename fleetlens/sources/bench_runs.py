"""Raw measurement documents: one JSON run per file, or many in files of JSON text sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARM = "struct<warmups:array<bigint>,samples:array<bigint>,rows:bigint>"
RUN_SCHEMA = (
    "case_id string, run bigint, recorded_at string, units string, "
    "protocol struct<warmups:bigint,samples:bigint>, "
    "query struct<sql:string,params:array<string>,rows:bigint>, "
    "index struct<name:string,ddl:string,build_us:bigint,size_bytes:bigint>, "
    "dataset map<string,bigint>, server struct<version:string,image_digest:string>, "
    "client map<string,string>, host map<string,string>, session_settings array<string>, "
    f"arms map<string,{ARM}>"
)
#: Ends a document of a JSON text sequence (RFC 7464); JSON text never holds it unescaped.
SEPARATOR = "\x1e"
_REQUIRED = ("case_id", "run", "arms")


def parse_bench_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`documents` (file, value) to (runs, problems); unusable documents become problems."""
    parsed = documents.withColumn(
        "doc",
        F.from_json(
            "value",
            f"{RUN_SCHEMA}, _bad string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
        ),
    )
    problem = F.when(
        F.col("doc").isNull() | F.col("doc._bad").isNotNull(), "unreadable or malformed JSON"
    )
    for name in _REQUIRED:
        problem = problem.when(
            F.col(f"doc.{name}").isNull(), f"missing required field '{name}'"
        )
    parsed = parsed.withColumn("problem", problem)
    runs = parsed.where("problem IS NULL").select(
        "file", F.col("doc").dropFields("_bad").alias("doc")
    )
    return runs.select("file", "doc.*"), parsed.where("problem IS NOT NULL").select("file", "problem")


def write_bench_sequences(documents: DataFrame, path: str) -> None:
    """Write the documents `value` below `path` as JSON text sequences, many to a file.

    A file for each document costs more than the document once there are very many of them.
    """
    documents.select("value").write.text(path, lineSep=SEPARATOR)


def read_bench_runs(spark: SparkSession, path: str, sequences: bool = False) -> tuple[DataFrame, DataFrame]:
    """Run documents below `path`, one per file, or as JSON text sequences.

    Documents of a sequence may have any number of lines.
    """
    if sequences:
        documents = spark.read.text(path, lineSep=SEPARATOR)
    else:
        documents = spark.read.text(path, wholetext=True)
    return parse_bench_documents(documents.withColumn("file", F.input_file_name()))


def long_samples(runs: DataFrame) -> DataFrame:
    """(case_id, run, arm, kind, idx, value_us, rows): one row per raw sample."""
    arms = runs.select("case_id", "run", F.explode("arms").alias("arm", "a"))
    kinds = F.array(
        F.struct(F.lit("warmup").alias("kind"), F.col("a.warmups").alias("values")),
        F.struct(F.lit("sample").alias("kind"), F.col("a.samples").alias("values")),
    )
    return (
        arms.select("case_id", "run", "arm", F.col("a.rows").alias("rows"), F.inline(kinds))
        .select("case_id", "run", "arm", "kind", "rows", F.posexplode("values").alias("idx", "value_us"))
    )
