"""Minimax contiguous sharding (native DataFrame operations only).

Rows with equal texts form an atomic group. Groups stand in the order of a 60-bit hash of
their text; the shard capacity is the smallest for which a greedy walk over that order
needs no more than the wanted number of shards, found by binary search. The walk sees the
order through a tree of hash ranges with their byte sums, and asks Spark for the children
of a range only where a cut may fall in it: what reaches the driver is bounded by the
shard count, not by the rows.

A group above the fair share of what is left (a hot text) gets a shard of its own first, so
that it does not set the capacity of all others.

Defined cases: a null text counts as empty (size 16, crc 0); equal rows are counted first and
numbered in chunks, so a row may come any number of times; an empty table gives an empty result; more shards than groups leave shards empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, whole_text

KEY_BITS, FIRST_BITS, STEP_BITS = 60, 12, 6
ROWS_PER_SLOT_BUCKET, ROWS_PER_CHUNK = 20_000, 1_000


class RangeTree:
    """Leaves of the hash order: start key, bits, bytes and number of keys of each."""

    def __init__(self, groups: DataFrame):
        self.groups, self.asked = groups, 0
        self.leaves = self._read(FIRST_BITS)

    def _read(self, bits: int, above: list[int] | None = None, above_bits: int = 0) -> list[tuple[int, int, int, int]]:
        rows = self.groups
        if above is not None:
            wanted = rows.sparkSession.createDataFrame([(x,) for x in above], "above long")
            rows = rows.join(F.broadcast(wanted), F.shiftright("key", KEY_BITS - above_bits) == F.col("above"), "left_semi")
        self.asked += 1
        got = rows.groupBy(F.shiftright("key", KEY_BITS - bits).alias("range")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("keys")).collect()
        return [(r["range"] << (KEY_BITS - bits), bits, r["bytes"], r["keys"]) for r in sorted(got)]

    def refine(self, which: list[int]) -> None:
        """Replaces these leaves by their children."""
        by_bits: dict[int, list[int]] = {}
        for i in which:
            by_bits.setdefault(self.leaves[i][1], []).append(i)
        gone, new = set(which), []
        for bits, own in by_bits.items():
            new += self._read(min(KEY_BITS, bits + STEP_BITS), [self.leaves[i][0] >> (KEY_BITS - bits) for i in own], bits)
        self.leaves = sorted([x for i, x in enumerate(self.leaves) if i not in gone] + new)

    def walk(self, capacity: int, shards: int) -> tuple[list[int], list[int], bool, bool]:
        """Leaf numbers at which a greedy walk cuts, early and late, and whether each reaches the end."""
        ends = np.cumsum([x[2] for x in self.leaves]) if self.leaves else np.zeros(0, np.int64)
        out = []
        for late in (False, True):
            cuts, at = [0], 0
            for _ in range(shards):
                done = int(ends[at - 1]) if at else 0
                new = int(np.searchsorted(ends, done + capacity, "right"))
                if late and new < len(ends) and self.leaves[new][3] > 1:
                    new += 1  # as if all of the leaf still went in
                at = max(at, new)
                cuts.append(at)
                if at >= len(ends):
                    break
            out.append((cuts, at >= len(ends)))
        return out[0][0], out[1][0], out[0][1], out[1][1]


def smallest_capacity(tree: RangeTree, shards: int, least: int) -> tuple[int, list[int]]:
    """The smallest capacity a greedy walk can keep to, and the start keys of the shards after the first."""
    total = sum(x[2] for x in tree.leaves)
    low, high = max(least, -(-total // max(1, shards)), 1), max(total, least, 1)
    while low < high:
        mid = (low + high) // 2
        while True:
            early, late, fits, could = tree.walk(mid, shards)
            if fits or not could:
                break
            open_ = sorted({i for k in range(1, max(len(early), len(late))) for i in range(early[min(k, len(early) - 1)], min(late[min(k, len(late) - 1)] + 1, len(tree.leaves))) if tree.leaves[i][3] > 1})
            if not open_:
                break
            tree.refine(open_)
        low, high = (low, mid) if fits else (mid + 1, high)
    while True:
        early, _, fits, _ = tree.walk(low, shards)
        if fits:
            break
        tree.refine([i for i in {min(c, len(tree.leaves) - 1) for c in early} if tree.leaves[i][3] > 1])
    return low, [tree.leaves[c][0] for c in early[1:] if c < len(tree.leaves)]


def shard_plan(groups: DataFrame, shards: int) -> tuple[list[int], list[int], int]:
    """Keys with a shard of their own, start keys of the other shards but the first, and the capacity."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    largest = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    while len(alone) < min(len(largest), shards - 1) and largest[len(alone)]["bytes"] * (shards - len(alone)) > total:
        total -= largest[len(alone)]["bytes"]
        alone.append(largest[len(alone)]["key"])
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    least = largest[len(alone)]["bytes"] if len(alone) < len(largest) else 0
    capacity, cuts = smallest_capacity(RangeTree(rest), shards - len(alone), least)
    return alone, cuts, capacity


def text_key(text: Column) -> Column:
    """60 bits that are equal for equal texts."""
    return F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS)


def assign(key: Column, alone: list[int], cuts: list[int]) -> Column:
    """The shard of a key: a look-up in literals, whose number is the shard count."""
    shard = F.lit(len(alone))
    if cuts:
        shard = shard + F.aggregate(F.array(*[F.lit(c).cast("long") for c in cuts]), F.lit(0), lambda n, c: n + (key >= c).cast("int"))
    if alone:
        own = F.array_position(F.array(*[F.lit(a).cast("long") for a in alone]), key).cast("int")
        shard = F.when(own > 0, own - 1).otherwise(shard)
    return shard.cast("int")


def number_slots(rows: DataFrame, order: list[str], per_bucket: int = ROWS_PER_SLOT_BUCKET, chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows of shard, order and times as so many rows with a slot, gapless from 0 in each shard.

    Equal rows are counted, not carried, until they are numbered: in chunks that are dealt to buckets of a shard, each
    bucket numbered apart and moved by what lies before it.
    """
    n = rows.agg(F.sum("times")).first()[0] or 0
    buckets = max(1, 1 << max(0, math.ceil(math.log2(max(1, n / per_bucket)))))
    each = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / chunk)))).withColumn("_n", F.least(F.lit(chunk), F.col("times") - F.col("_c") * chunk))
    each = each.withColumn("_b", F.pmod(F.xxhash64(*order, "_c"), F.lit(buckets)).cast("int"))
    sizes = each.groupBy("shard", "_b").agg(F.sum("_n").alias("_all"))
    before = sizes.select("shard", "_b", (F.sum("_all").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_all")).alias("_before"))
    inside = each.withColumn("_i", F.sum("_n").over(Window.partitionBy("shard", "_b").orderBy(*order, "_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    start = F.col("_before") + F.col("_i")
    return inside.join(before, ["shard", "_b"]).withColumn("slot", F.explode(F.sequence(start, start + F.col("_n") - 1))).drop("_b", "_c", "_n", "_i", "_before", "times")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, key and shard of every document (written once, slim), with slots."""
    text = whole_text()
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"))
    slim = materialize(slim.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("times")), "shard-rows")
    groups = materialize(slim.groupBy("key").agg(F.sum(F.col("size") * F.col("times")).alias("bytes"), F.sum("times").alias("rows")), "shard-groups")
    alone, cuts, _ = shard_plan(groups, shards)
    return number_slots(slim.withColumn("shard", assign(F.col("key"), alone, cuts)), ["doc_id", "text_crc32", "size", "key"])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
