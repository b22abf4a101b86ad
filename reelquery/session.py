"""Spark sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "reelquery", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries assume; a cluster's own settings win where they are given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
