"""Ranked picks: last write wins, first n of a group, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order (make it total)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_write(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Of rows with one key, the one with the greatest sequence: an aggregation, combined before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*sequence, *(c for c in rest if c not in sequence))).alias("_last"))
    return picked.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns))


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """batch and 1-based id within the batch, numbering each key's rows in an order (make it total)."""
    if keys:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    else:
        df, n = _numbered_ranges(df, order)
    return df.withColumn("batch", F.floor(n / size).cast("int")).withColumn("id", (n % size + 1).cast("int")).drop("_range", "_at")


def _numbered_ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, Column]:
    """df as a stored table with _range and _at, and each row's 0-based number in an ascending order, without a task that has all rows.

    What makes df runs once. Its rows are dealt to ranges and sorted there; a row's number is the count of rows in the
    ranges before, and its place in its own.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = stored(df, "to-number")  # read twice: for the bounds of the ranges, and to be dealt
    dealt = own.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    df = stored(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before, total = [F.lit(-1), F.lit(0)], 0
    for r in df.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # as many rows as ranges
        before += [F.lit(r["_range"]), F.lit(total)]
        total += r["n"]
    return df, F.col("_at") + F.element_at(F.create_map(*before), F.col("_range"))
