"""A session with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "loomspark", cores: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a process that a launcher started (spark-submit) gets a session with the launcher's settings."""
    if "PYSPARK_GATEWAY_PORT" in os.environ:
        return SparkSession.builder.appName(app).getOrCreate()
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LOOMSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
