"""A SparkSession with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lexigraph", **conf: str) -> SparkSession:
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    }
    builder = SparkSession.builder.appName(app)
    for k, v in (own | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
