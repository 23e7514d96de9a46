"""Session settings shared by tests, the bench and ad-hoc runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fleetlens", master: str = "local[8]", **extra: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster the launcher sets the master, memory and ``spark.checkpoint.dir``;
    only time zone, AQE and skew handling matter for results and plans.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
