"""Spark sessions for tests, benchmarks and local use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session in one JVM. On a cluster, use the session that the launcher gives instead."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("TICKWEAVE_DRIVER_MEMORY", memory),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("tickweave").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
