"""What the operators share: reading, shared scratch tables, byte-level words."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


BATCH_BYTES = 16 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lexigraph-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only where that is unset on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of a batch that is sent to Python, unless the session has a lower bound: rows of a batch may be long."""
    own = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_CONF))
    if own and not 0 < int(own[1]) <= most:
        spark.conf.set(_BATCH_CONF, str(most))


def give_back() -> None:
    """Returns memory that a task of a reused Python worker has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not that C library
        pass


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded bytes, after which a worker keeps no memory of the task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigraph/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


SMALL_ROWS = 100_000


def is_small(df: DataFrame, most: int | None = None) -> bool:
    """Whether df has at most so many rows."""
    most = SMALL_ROWS if most is None else most
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df to be broadcast if it has at most so many (slim) rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if is_small(df, most) else df


def own_names(columns: list[str], added) -> dict[str, str]:
    """The name in a result of each column of the input: `own_` stands before one that an added column has (in any case of letters)."""
    taken, out = {c.lower() for c in [*added, *columns]}, {}
    for c in columns:
        name = c
        while name != c and name.lower() in taken or name == c and c.lower() in {a.lower() for a in added}:
            name = "own_" + name
        out[c] = name
        taken.add(name.lower())
    return out


def with_own_names(docs: DataFrame, added) -> DataFrame:
    """docs with columns renamed that an added one would clash with: nothing of theirs is lost."""
    return docs.select(*(F.col(f"`{c}`").alias(name) for c, name in own_names(docs.columns, added).items()))


def with_first_names(result: DataFrame, columns: list[str], added) -> DataFrame:
    """The columns of the input alone, under their first names, of a result that added others."""
    return result.select(*(F.col(f"`{name}`").alias(c) for c, name in own_names(columns, added).items()))


def held_out_fold(modulus: int, fold: int = 2) -> Column:
    """crc32(doc_id as text) mod modulus = fold; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold, F.lit(False))


def field(name: str, kind) -> T.StructField:
    return T.StructField(name, kind, True)


# --- words of whole texts, found on their UTF-8 bytes -----------------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.ones(1, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWER
    if len(_POWER) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        _POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _STEP, np.uint64)]))
    return _POWER


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column, and where each row starts and the last one ends. Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or not offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without ASCII white space) and the first word's number of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased if asked; equal words, equal hashes, in any process."""
    if not len(start):
        return np.zeros(0, np.uint64)
    cut = [*np.unique(np.searchsorted(start, np.arange(start[0], end[-1], _SPAN))).tolist(), len(start)]
    return np.concatenate([_hash_run(data, start[a:b], end[a:b], lower) for a, b in zip(cut, cut[1:]) if b > a])


def _hash_run(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of words that begin within a bounded span, as arrays with an item for each of their bytes."""
    size = end - start
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte = data[np.repeat(start, size) + place]
    term = _BYTE[_LOWER[byte] if lower else byte] * _powers(int(size.max()))[place]
    return mix64(np.add.reduceat(term, np.cumsum(size) - size) + size.astype(np.uint64))


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch of about `most` bytes of the column each, a longer value in a slice of its own."""
    own = batch.column(column)
    if pa.types.is_list(own.type):
        inner = own.flatten()
        inner = inner.field("pcm") if pa.types.is_struct(inner.type) else inner
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)))
        size = pc.fill_null(pc.binary_length(inner), 0).to_numpy(zero_copy_only=False) if pa.types.is_binary(inner.type) else np.full(len(inner), inner.type.bit_width // 8)
        lengths = np.diff(np.append(0, np.cumsum(size))[ends])
    else:
        lengths = pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield batch.slice(begin)


HOT_SHARE = 256


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """rows joined with table, which has each key once and says in `count` how many rows have it, salted where a key is hot.

    A key in more than 1 / share of these rows is dealt over as many salts as it has such shares: its rows by a hash of
    themselves, its entry in the table once for each. There are at most `share` such keys, so the list of them that is
    broadcast (keys and numbers of salts) is bounded, and the table grows by at most 2 * share rows. Where there is none,
    or few rows in all, it is a plain join.
    """
    table = table.where(" and ".join(f"{k} is not null" for k in keys))
    total, most = table.agg(F.sum(count), F.max(count)).first()
    if total is None or total <= SMALL_ROWS or most * share <= total:  # few rows, or no key that is hot
        return rows.join(table, keys, how)
    salts = (F.floor(F.col(count) * share / F.lit(max(1, total))) + 1).cast("int")
    hot = F.broadcast(table.select(*keys, salts.alias("_salts")).where("_salts > 1"))
    mine = F.pmod(F.xxhash64(*rows.columns), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", mine).drop("_salts")
    each = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(each, [*keys, "_salt"], how).drop("_salt")
