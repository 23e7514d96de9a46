"""Running a stream over the files at hand and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.sources.scratch import new_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(stream: DataFrame) -> None:
    """Keep state in RocksDB: it may outgrow memory, and arbitrary state needs it."""
    stream.sparkSession.conf.set(_PROVIDER, ROCKSDB)


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append finished rows to a Parquet table; exactly once by the file sink's own log."""
    writer = stream.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_updates(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", once: bool = True
) -> StreamingQuery:
    """Write each batch's changed rows to its own folder, which a retry overwrites."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of each key of an update table."""
    rest = [c for c in updates.columns if c not in (*keys, "epoch")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), "epoch").alias("row"))
        .select(*keys, "row.*")
    )


def drain(stream: DataFrame, label: str, updates: bool = False, mode: str = "update") -> DataFrame:
    """Run `stream` over all files there are, and return the table it wrote.

    A stream keeps its number of state partitions for life and the adaptive planner does not
    merge them, so it starts with one per core of the cluster.
    """
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    try:
        if updates:
            query = start_updates(stream, path, checkpoint, mode)
        else:
            query = start_append(stream, path, checkpoint)
        query.awaitTermination()
    finally:
        spark.conf.set(_PARTITIONS, before)
    if query.exception() is not None:
        raise query.exception()
    return spark.read.option("basePath", path).parquet(path)
