"""Session defaults shared by tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: str = "*", partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with UTC time, AQE and Arrow; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestar")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
