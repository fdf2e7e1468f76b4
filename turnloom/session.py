"""A session with what the engine's plans want; settings of the cluster go first."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split skewed joins and merge small partitions; time is UTC in all tables.
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def session(name: str = "turnloom", **settings: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | settings).items():
        b = b.config(k, v)
    return b.getOrCreate()
