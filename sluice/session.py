"""Session builder shared by tests, bench and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "sluice", cpus: int | None = None, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive execution)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
