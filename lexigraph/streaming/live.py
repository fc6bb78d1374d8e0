"""The usage log as a live table: each event counts once, however late or often it comes, also over restarts.

A micro-batch is laid over the stored events of the days it touches, and what is not there yet is stored in a folder
of the batch's number. A batch that runs again after a fault replaces that folder, so it is merged once. The stored
days are the keyed state: an event may be late by any time, only its day is read. Daily totals lie beside the
events, a row for each day, tool and batch, and are summed when read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import manifest as M
from ..schema import USAGE_EVENT

_EVENTS = "ts long, tool string, q string, hit boolean, chars int, ms long, _batch long, day date"
_DAYS = "day date, tool string, n long, hits long, chars long, ms long, _batch long"


def _day(ts: str = "ts"):
    return F.to_date(F.timestamp_millis(ts)).alias("day")


def _batches(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    there = [n for n in M.names_in(spark, folder) if n.startswith("_batch=")]
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/{n}" for n in there))


def stored_events(spark: SparkSession, store: str) -> DataFrame:
    return _batches(spark, f"{store}/events", _EVENTS)


def merge_into(store: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges a batch of events into the store."""
    names = USAGE_EVENT.fieldNames()

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*names).where("ts is not null and tool is not null").distinct().withColumn("day", _day())
        new = new.persist()
        try:
            days = [r[0] for r in new.select("day").distinct().collect()]  # of one batch
            seen = stored_events(spark, store).where((F.col("_batch") != number) & F.col("day").isin(days)) if days else stored_events(spark, store).limit(0)
            a, b = new.alias("a"), seen.select(*names).alias("b")
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
            fresh = a.join(b, same, "left_anti")
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{store}/events/_batch={number}")
            own = spark.read.schema(_EVENTS).option("basePath", f"{store}/events").parquet(f"{store}/events/_batch={number}")
            totals = own.groupBy("day", "tool").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum(F.col("chars").cast("long")).alias("chars"), F.sum("ms").alias("ms"))
            totals.write.mode("overwrite").parquet(f"{store}/days/_batch={number}")
        finally:
            new.unpersist()

    return run


def start(spark: SparkSession, log: str, store: str, checkpoint: str, files_per_batch: int | None = None, **trigger) -> StreamingQuery:
    """A query that follows the log's JSON lines; trigger as in `DataStreamWriter.trigger`, all that is there by default."""
    reader = spark.readStream.schema(USAGE_EVENT)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    writer = reader.json(log).writeStream.foreachBatch(merge_into(store)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def daily(spark: SparkSession, store: str) -> DataFrame:
    """day, tool, events, hits, chars and ms of all batches so far."""
    rows = _batches(spark, f"{store}/days", _DAYS)
    return rows.groupBy("day", "tool").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "chars", "ms")))
