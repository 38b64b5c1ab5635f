"""Session construction for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_import_this(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library where it is not installed but lies on the same path."""
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "lumenry", **conf: str) -> SparkSession:
    """A local session with AQE on, UTC time and case-sensitive names (wide score files differ by case only)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
