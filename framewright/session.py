"""Session helper for tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "6g", **extra: str) -> SparkSession:
    """A UTC session on ``local[cpus]``; clusters bring their own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framewright")
        .config("spark.driver.memory", os.environ.get("FRAMEWRIGHT_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
