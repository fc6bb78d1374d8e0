"""Packing documents into sequences of at most a given length.

Each document's ids (with an end id) are cut into pieces of the sequence length and a
remainder. Pieces are dealt into random groups of bounded size; in each group, apart from
all others, first-fit decreasing puts them into bins, finding the first bin with room
through a tournament tree of the bins' free space. Groups never meet, so the work is a
single shuffle of slim rows, and hot documents spread over groups.

Defined cases: a null text counts as empty and is a piece with the end id alone; pieces of
equal length are taken in the order of doc_id and start; repeated rows are packed
each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import coder, default_path
from .common import documents, map_batches, materialize, pieces

LENGTH, END_ID, GROUP_PIECES = 2048, 1, 8192


class TournamentTree:
    """Free space of bins in a complete binary tree: each node has the most below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes size from the first bin that has it and returns that bin's number."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        bin_ = node - self.leaves
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (all at most capacity), larger ones first, ties as they stand."""
    tree, used = TournamentTree(len(sizes), capacity), {}
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + size
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document; no row crosses the network."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches):
        own = coder(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, counts = own.encode([t or "" for t in part.column("text").to_pylist()])
                out, at = [], 0
                for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    data = np.append(ids[at : at + n], end_id).astype("<u4").tobytes()
                    at += n
                    for start in range(0, n + 1, length):
                        end = min(n + 1, start + length)
                        out.append((doc_id, start, end - start, zlib.crc32(data[4 * start : 4 * end]), n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        own.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, cut, PIECES)


def pack_pieces(rows: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces that has a random column `_random`."""
    groups = max(1, math.ceil(rows.count() / group_pieces))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(), length)
        return frame.assign(sequence_id=(frame["_group"].to_numpy(np.int64) << 32) + bins, offset=offsets).drop(columns="_group")

    grouped = rows.withColumn("_group", F.least(F.floor(F.col("_random") * groups), F.lit(groups - 1)).cast("long")).drop("_random")
    names = [f for f in rows.schema.fields if f.name != "_random"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in names), "sequence_id long", "offset long"])
    return grouped.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    rows = materialize(token_pieces(docs, path, length, end_id).withColumn("_random", F.rand(9)), "pieces")
    return pack_pieces(rows, length, group_pieces)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_path("byte_bpe_50k.json"))
