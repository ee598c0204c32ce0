"""Spark sessions with the settings that this library's plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "leafline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, skew handling and UTC; ``conf`` overrides them."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
