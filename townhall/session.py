"""Session settings that the operators' semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; cluster sizing is left to the deployment."""
    builder = SparkSession.builder.appName("townhall").config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()
