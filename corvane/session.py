"""Session defaults: adaptive execution, UTC, Arrow batches sized for vectors."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "corvane", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
