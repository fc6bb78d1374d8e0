"""Intermediate tables that are used more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lexigraph-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an own one only where that is unset on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read again: what makes it runs once, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lexigraph/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Bounds the bytes of a batch that is sent to Python, unless the session has a lower bound: rows of a batch may be long."""
    own = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_CONF))
    if own and not 0 < int(own[1]) <= most:
        spark.conf.set(_BATCH_CONF, str(most))
