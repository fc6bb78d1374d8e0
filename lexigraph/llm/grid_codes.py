"""Compression of vectors to short codes: a codebook for each part of a vector, nearest entries by memoised grid cells.

Vectors are integers (`scale` steps to one), cut into `parts` consecutive parts. The codebook of each
part is refined over all vectors, a round at a time: a task assigns the parts of its vectors to their
nearest entries, sums them by entry, and only these sums (`parts * entries` rows a task) are shuffled.

A part's nearest entry is found through its coarse cell, the part with the low `cell_bits` bits of
each component cut off, by a hash of it. For a cell that was not met before, every entry's least and
greatest distance to the cell's box are computed; an entry whose least distance is above another's
greatest is dominated in the whole box. The others are remembered for the cell, and only they are
measured exactly. A task remembers at most `cells` cells a part; the entries of cells beyond are found
again in each batch, with the same result. Two cells with one hash are told apart by their
coordinates, and then all entries are measured.

Defined cases: see `vectors.usable` for vectors that are dropped; a product beyond +-2**27 steps
is held to that bound (so that distances fit a long); a length that the number of parts does not divide
is filled up with zeros; fewer vectors than entries give so many entries; a null id comes after all
others; equal ids are ordered by their vectors; a sum of errors beyond a long is null; other columns,
whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, map_batches, materialize, mix64
from .vectors import matrix, scaled, usable

PARTS, ENTRIES, ROUNDS, SCALE, CELL_BITS, CELLS = 8, 16, 6, 4096, 9, 1 << 16
MOST = 1 << 27
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Cells:
    """The entries of one codebook that are not dominated in a cell's box, for cells met so far."""

    def __init__(self, book: np.ndarray, bits: int, most: int = CELLS):
        self.book, self.bits, self.most = book, bits, most
        self.keys = np.zeros(0, np.uint64)
        self.cells = np.zeros((0, book.shape[1]), np.int64)
        self.masks = np.zeros((0, len(book)), bool)

    def open_entries(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries no other entry dominates in its box."""
        low = (cells << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        below, above = low - self.book, self.book - high
        outside = np.maximum(0, np.maximum(below, above))
        least = (outside * outside).sum(2)
        far = np.maximum(np.abs(below), np.abs(above))
        greatest = (far * far).sum(2)
        return least <= greatest.min(1)[:, None]

    def lookup(self, keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The masks of cells with these sorted distinct keys; new ones are found, and remembered while there is room."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out = np.ones((len(keys), len(self.book)), bool)  # a known key of another cell: all entries
        same = np.flatnonzero(known)
        same = same[(self.cells[at[same]] == cells[same]).all(1)]
        out[same] = self.masks[at[same]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.open_entries(cells[new])
            new = new[: max(0, self.most - len(self.keys))]
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.cells = np.concatenate([self.cells, cells[new]])[order]
            self.masks = np.concatenate([self.masks, out[new]])[order]
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, the least index of equally near ones, and its squared distance."""
        cells = points >> self.bits
        hashes = np.zeros(len(points), np.uint64)
        for i in range(points.shape[1]):
            hashes = mix64(hashes * _STEP + cells[:, i].astype(np.uint64))
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        own = cells[first]
        masks = self.lookup(keys, own)[back]
        masks[(cells != own[back]).any(1)] = True
        row, entry = np.nonzero(masks)
        gap = points[row] - self.book[entry]
        rank = (gap * gap).sum(1).astype(np.uint64) * np.uint64(len(self.book)) + entry.astype(np.uint64)
        best = np.minimum.reduceat(rank, np.searchsorted(row, np.arange(len(points))))
        return (best % np.uint64(len(self.book))).astype(np.int64), (best // np.uint64(len(self.book))).astype(np.int64)


def _slices(batches, dims: int, most: int = 8192):
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            part = batch.slice(begin, most)
            yield part, matrix(part.column("x"), dims)


def sums_by_entry(rows: DataFrame, books: np.ndarray, bits: int) -> DataFrame:
    """part, entry, at (position in the part), n and total over all rows (x), combined in the task before the shuffle."""
    parts, entries, width = books.shape

    def run(batches):
        cells = [Cells(b, bits) for b in books]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, x in _slices(batches, parts * width):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = cells[p].nearest(own)
                order = np.argsort(entry, kind="stable")
                used, begin = np.unique(entry[order], return_index=True)
                total[p, used] += np.add.reduceat(own[order], begin, axis=0)
                count[p] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(count)
        if len(p):
            at = np.tile(np.arange(width), len(p))
            p, e = np.repeat(p, width), np.repeat(e, width)
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in ((p, pa.int32()), (e, pa.int32()), (at, pa.int32()), (count[p, e], pa.int64()), (total[p, e, at], pa.int64()))], names=["part", "entry", "at", "n", "total"])

    each = map_batches(rows.select("x"), run, "part int, entry int, at int, n long, total long")
    return each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def fit_codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = CELL_BITS) -> np.ndarray:
    """Codebooks (part, entry, position) after so many rounds over all rows (vec_id, x), from the vectors of the least ids.

    What comes to the driver is a codebook's size: its first vectors, then the sums of its entries.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in sums_by_entry(rows, books, bits).collect():
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def encoded(rows: DataFrame, books: np.ndarray, bits: int = CELL_BITS) -> DataFrame:
    """rows with code (two hex digits for each part) and error (squared distance) in place of x."""
    kept = [c for c in rows.columns if c != "x"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", code string, error long"
    parts, _, width = books.shape

    def run(batches):
        cells = [Cells(b, bits) for b in books]
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch, x in _slices(batches, parts * width):
            found = [c.nearest(x[:, p * width : (p + 1) * width]) for p, c in enumerate(cells)]
            code = ["".join(row) for row in digits[np.stack([entry for entry, _ in found], 1)].tolist()]
            error = np.sum([distance for _, distance in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(code, pa.string()), pa.array(error, pa.int64())], names=[*kept, "code", "error"])

    return map_batches(rows, run, schema)


def compress(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = CELL_BITS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every usable row of vectors (vec_id, embedding, label), and the codebooks."""
    held, dims = usable(vectors.select("vec_id", "label", "embedding"))
    filled = -(-dims // parts) * parts
    x = scaled("embedding", scale, MOST)
    x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), filled - dims)) if filled > dims else x
    rows = held.select("vec_id", "label", x.alias("x"))
    if not dims:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    rows = materialize(rows, "gc-rows")
    books = fit_codebooks(rows, filled, parts, entries, rounds, bits)
    return encoded(rows, books, bits), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 (lower-case hex) of all components in order of part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes (code) with approx, the vector (array<double>) that the code stands for."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in book]) for book in books.tolist()])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approx", F.concat(*[table[p][at(p)] for p in range(len(books))]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    keyed = codes.select("vec_id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label_key"))
    keyed = materialize(keyed, "gc-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums = keyed.groupBy("none", "label_key").agg(total.alias("label_error"), F.count("*").alias("n"))
    out = join_counted(keyed, sums, ["none", "label_key"], "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain assignment of every part to all entries, a table for each round."""
    nearest = """
{name} as (
  select vec_id, label, part, x, (select min(row(list_sum(list_transform(list_zip(b.x, p.x), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), b.entry)) from {book} b where b.part = p.part) as best
  from parts p)"""
    update = """
{name} as materialized (
  select b.part, b.entry, coalesce(n.x, b.x) as x from {book} b left join (
    select part, entry, list(v order by pos) as x from (
      select part, best[2] as entry, pos, floor(sum(x[pos]) / count(*))::bigint as v from {assigned}, range(1, {width} + 1) r(pos) where pos <= len(x) group by all)
    group by all) n on b.part = n.part and b.entry = n.entry)"""
    steps = [
        f"""kept as (
  select vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)""",
        f"""parts as materialized (
  select vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] as x from kept, range({parts}) r(part))""",
        f"""book0 as materialized (
  select part, row_number() over (partition by part order by vec_id, x) - 1 as entry, x from parts
  qualify row_number() over (partition by part order by vec_id, x) <= {entries})""",
    ]
    for i in range(rounds):
        steps.append(nearest.format(name=f"near{i}", book=f"book{i}").strip())
        steps.append(update.format(name=f"book{i + 1}", book=f"book{i}", assigned=f"near{i}", width=64).strip())
    steps.append(nearest.format(name="last", book=f"book{rounds}").strip())
    steps.append("coded as (select vec_id, label, string_agg(lpad(to_hex(best[2]), 2, '0'), '' order by part) as code, sum(best[1])::bigint as error from last group by vec_id, label)")
    return "with " + ",\n".join(steps) + f"""
select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) from (select part, entry, unnest(x) as v, generate_subscripts(x, 1) as pos from book{rounds})) as codebooks_sha256
from coded"""
