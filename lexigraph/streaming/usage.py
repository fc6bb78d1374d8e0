"""Windowed counts of usage events; each works on a batch table and on a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import USAGE_EVENT


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The usage log as a stream of its JSON lines, late by an hour at most."""
    events = spark.readStream.schema(USAGE_EVENT).json(path)
    return events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", "1 hour")


def _counted(events: DataFrame, window) -> DataFrame:
    a = events.groupBy(window.alias("w"), "tool").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return a.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tool", "n", "hits")


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return _counted(events, F.window("at", size))


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours") -> DataFrame:
    return _counted(events, F.window("at", size, step))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each q: runs of events less than a gap apart."""
    a = events.groupBy(F.session_window("at", gap).alias("w"), "q").agg(F.count("*").alias("n"))
    return a.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "q", "n")
