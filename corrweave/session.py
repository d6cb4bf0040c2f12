"""Session factory for tests, benchmarks and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "corrweave", cores: str | int = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Local session with the settings the library is tested under; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
        .config("spark.driver.memory", os.environ.get("CORRWEAVE_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
