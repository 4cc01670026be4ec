"""A Spark session with the settings the library was tuned with; any session works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "staycoder", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # vectors are pooled in object aggregates: keep them hashed beyond 128 groups per task
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
        # notes and prompts can be long: hand them to plugged-in models in smaller Arrow batches
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
