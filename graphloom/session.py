"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow; further settings by keyword with dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
