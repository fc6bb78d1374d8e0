"""Beyond one-hop reads: k hops, decayed confidence, nearest vectors."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import first_per_key


def k_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """node and the fewest hops to it from any start (column node), along src to dst, up to `hops`.

    Each step joins the frontier only, and leaves out nodes seen before.
    """
    step = edges.select(F.col("src_id").alias("node"), "dst_id").distinct()
    seen = starts.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = seen.select("node")
    for n in range(1, hops + 1):
        frontier = frontier.join(step, "node").select(F.col("dst_id").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.union(frontier.withColumn("hops", F.lit(n)))
    return seen


def decayed(edges: DataFrame, age_days: str, half_life: float) -> DataFrame:
    return edges.withColumn("decayed", F.col("confidence") * F.pow(F.lit(0.5), F.col(age_days) / F.lit(half_life)))


def _directed():
    """Whether a vector has a direction: its squares sum to a positive finite number."""
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.col("embedding").isNotNull() & (size > 0) & (size < float("inf"))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, most: int = 4096) -> DataFrame:
    """query_id, vec_id, similarity of the k most similar vectors of each query by cosine, itself left out.

    A stated query set against all vectors, in blocks of at most `most` queries: a block travels to the vectors, each
    task keeps its best k for each query (ties by the least vec_id), and only those meet. Vectors that are null or have no
    direction (all zero, or with a component that is not finite) are left out, as queries and as neighbours.
    """
    own = queries.where(_directed()).select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = max(1, -(-own.count() // most))
    best = None
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()  # about `most` rows
        if not len(part):
            continue
        ids, q = part["query_id"].to_numpy(), np.array(part["embedding"].tolist(), np.float64)
        found = vectors.where(_directed()).select("vec_id", "embedding").mapInArrow(partial(_best_of_task, ids, q / np.linalg.norm(q, axis=1, keepdims=True), k), "query_id long, vec_id long, similarity double")
        best = found if best is None else best.union(found)
    if best is None:
        return own.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double")
    return first_per_key(best, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("vec_id")], k)


def _best_of_task(ids, q, k, batches):
    """The best k of a task's vectors for each query."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        vec, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
        s = v @ q.T / np.linalg.norm(v, axis=1, keepdims=True)
        row, col = np.indices(s.shape).reshape(2, -1)
        if batch.num_rows > 4 * k:  # those that cannot be among the best k go first
            least = np.partition(s, -k - 1, axis=0)[-k - 1]
            row, col = np.nonzero(s >= least - 1e-9)
        new = vec[row] != ids[col]
        row, col = row[new], col[new]
        query, vec_id, sim = (np.concatenate(x) for x in zip(held, (col, vec[row], s[row, col])))
        order = np.lexsort((vec_id, -np.round(sim, 9), query))
        first = np.searchsorted(query[order], np.arange(len(ids)))
        rank = np.arange(len(order)) - first[query[order]]
        order = order[rank < k]
        held = query[order], vec_id[order], sim[order]
    yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "similarity"])
