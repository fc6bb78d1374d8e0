"""Substring search of concepts by an index of trigrams, kept beside the snapshot that it was made from.

A concept is listed under each run of three characters of its name, definition and aliases, lower-cased. A query
of three characters or more reads the lists of its own runs, no others: lists lie in folders by a checksum of the run, in
order within a file, so a scan opens those folders and skips the rest of their rows. What is in all lists is
verified; shorter queries scan the concepts. The index of a table of concepts serves all versions that have it.
"""

from __future__ import annotations

import hashlib
import json
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest as M
from . import serve, snapshot

RUN, BUCKETS, SPREAD = 3, 64, 4


def runs(text: Column) -> Column:
    """The distinct runs of three characters of a text, lower-cased."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.length(low) - (RUN - 1))
    cut = F.transform(starts, lambda i: F.substring(low, i, F.lit(RUN)))
    return F.array_distinct(F.when(F.length(low) >= RUN, cut).otherwise(F.array().cast("array<string>")))


def postings(concepts: DataFrame) -> DataFrame:
    """run and the id of each concept that has it in a field."""
    fields = F.concat(F.array("name", "definition"), F.coalesce("aliases", F.array().cast("array<string>")))
    kept = F.filter(fields, lambda f: f.isNotNull())
    return concepts.select("id", F.explode(F.array_distinct(F.flatten(F.transform(kept, runs)))).alias("run"))


def write_index(concepts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Lists by bucket of their run, a bucket dealt over a few tasks so that a frequent run is no single one's work."""
    rows = postings(concepts).withColumn("_bucket", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int"))
    dealt = rows.repartition("_bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("_bucket", "run", "id")
    dealt.write.mode("overwrite").partitionBy("_bucket").parquet(path)


def candidates(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """The ids that are in the lists of all runs of a query of three characters or more."""
    low = query.lower()
    own = sorted({low[i : i + RUN] for i in range(len(low) - RUN + 1)})
    where = sorted({zlib.crc32(r.encode()) % buckets for r in own})
    lists = spark.read.schema("id string, run string, _bucket int").parquet(path).where(F.col("_bucket").isin(where) & F.col("run").isin(own))
    return lists.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("id")


def search(spark: SparkSession, path: str, concepts: DataFrame, query: str, limit: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """What `serve.search_concepts` finds, by the index at path."""
    if len(query.lower()) >= RUN:
        concepts = serve.only_keys(concepts, candidates(spark, path, query, buckets), "id")
    return serve.search_concepts(concepts, query, limit)


def index_of(spark: SparkSession, root: str, version: int | None = None) -> str:
    """The folder of the index of a version's concepts, made if it is not there."""
    at = max(snapshot._versions(spark, root)) if version is None else version
    entry = M.load(spark, snapshot._manifest(root, at))["tables"]["concepts"]
    path = f"{root}/search/{hashlib.sha256(json.dumps(entry, sort_keys=True).encode()).hexdigest()[:32]}"
    if "_SUCCESS" not in M.names_in(spark, path):
        write_index(snapshot.read(spark, root, at).concepts, path)
    return path


def find(spark: SparkSession, root: str, query: str, limit: int = 20) -> DataFrame:
    """Concepts of the last version under root with the query in a field."""
    return search(spark, index_of(spark, root), snapshot.read(spark, root).concepts, query, limit)
