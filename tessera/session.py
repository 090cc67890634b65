"""Spark sessions with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "tessera", cores: int | str = 8, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, bring your own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "12g")} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
