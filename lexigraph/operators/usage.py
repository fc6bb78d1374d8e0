"""Roll-ups of the usage log (ts in ms, tool, q, hit, chars, ms); all are single aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import day_of, is_blank


def summary(events: DataFrame) -> DataFrame:
    """One row: events, first and last day, hits, hit rate in whole percent, volume served, mean ms (cut to whole)."""
    a = events.agg(
        F.count("*").alias("events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if("hit").alias("hits"),
        F.coalesce(F.sum(F.col("chars").cast("long")), F.lit(0)).alias("chars"),
        F.coalesce(F.avg("ms"), F.lit(0.0)).cast("long").alias("mean_ms"),
    )
    rate = F.when(F.col("events") > 0, F.expr("100 * hits div events")).otherwise(F.lit(0)).cast("long")
    return a.select("events", day_of("first_ts").alias("first_day"), day_of("last_ts").alias("last_day"), "hits", rate.alias("hit_percent"), F.expr("chars div 1024").alias("kb"), F.expr("chars div 4 div 1000").alias("k_tokens"), "mean_ms")


def by_tool(events: DataFrame) -> DataFrame:
    return events.groupBy("tool").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool")


def top_queries(events: DataFrame, limit: int = 8) -> DataFrame:
    return events.where(~is_blank("q")).groupBy("q").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "q").limit(limit)
