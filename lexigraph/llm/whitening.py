"""Whitening of embeddings by an eigendecomposition that is built from rank-one updates.

Vectors become integers, and each distinct one counts once. A task takes its vectors one by one:
its mean and spectrum are updated by the centred vector, for which a secular equation is solved
(`spectra`). Spectra, whose size is that of a covariance whatever the number of vectors, are combined
by successive rank-one updates, `fan` at a time in a tree of Spark groups. Rounding in so many updates
is then taken back by Rayleigh-Ritz steps: a pass over all vectors gives the covariance in the basis
found, whose own eigenvectors turn the basis, until what is off its diagonal is at the rounding of the
sums. Numbers and sums are exact integers, so vectors are centred without rounding ((n x - S) / n).

Defined cases: see `vectors.usable` for vectors that are dropped; a product beyond +-2**40 steps is
held to that bound; with fewer dimensions than components there are so many components; a component
without variance (one vector, or vectors that all lie in a plane) has whitened 0 and is left out of
identity_error; a deviation beyond a long is null; repeated and null ids give a row each; other
columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .spectra import Spectrum
from .vectors import matrix, scaled, usable

COMPONENTS, SCALE, ADD, FAN, STEPS = 16, 64, 1_000_000, 16, 4
MOST = 1 << 40
_LONG = (1 << 63) - 1
_SPECTRUM = "task long, n long, mean array<double>, `values` array<double>, basis array<double>"


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: number and sums of the fit list, components (columns) and eigenvalues by falling size."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)**2 of each row."""
        gap = scaled_gap(x, self.n, self.sums)
        if gap.dtype != object and (not gap.size or int(np.abs(gap).max()) ** 2 * gap.shape[1] <= _LONG):
            return (gap * gap).sum(1).tolist()
        return [d if d <= _LONG else None for d in ((gap.astype(object) ** 2).sum(1)).tolist()]


def scaled_gap(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in Python's integers where a long may not hold it."""
    most = max(map(abs, sums.tolist()), default=0) + n * (int(np.abs(x).max()) if x.size else 0)
    return x * n - sums.astype(np.int64) if most <= _LONG else x.astype(object) * n - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (scaled_gap(x, n, sums) / n).astype(np.float64)


def _slices(batches, dims: int, most: int = 8192):
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            part = batch.slice(begin, most)
            yield part, matrix(part.column("x"), dims)


def fit_sums(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of vectors and their exact sum in each dimension."""

    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for _, x in _slices(batches, dims):
            n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total.tolist(), pa.int64())], names=["at", "n", "total"])

    each = map_batches(fit.select("x"), run, "at int, n long, total long")
    rows = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.zeros(dims, object)
    for r in rows:
        sums[r["at"]] = int(r["total"])
    return (rows[0]["n"] if rows else 0), sums


def _row(task: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([a.tolist()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.basis.ravel())]
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([s.n], pa.int64()), *lists], names=["task", "n", "mean", "values", "basis"])


def _spectrum(row) -> Spectrum:
    mean = np.array(row["mean"], np.float64)
    return Spectrum(int(row["n"]), mean, np.array(row["values"], np.float64), np.array(row["basis"], np.float64).reshape(len(mean), len(mean)))


def partial_spectra(fit: DataFrame, dims: int, add: int = ADD) -> DataFrame:
    """A spectrum of each partition that has vectors, by an update for each of them."""

    def run(batches):
        from pyspark import TaskContext

        s = Spectrum.empty(dims)
        for _, x in _slices(batches, dims):
            for v in (x - add).astype(np.float64):
                s.add(v)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    return map_batches(fit.select("x"), run, _SPECTRUM)


def combined(spectra: DataFrame, fan: int = FAN) -> Spectrum | None:
    """One spectrum from all of a written table, `fan` of them at a time; the last one comes to the driver."""

    def merge(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["task"])
        s = _spectrum(rows[0])
        for r in rows[1:]:
            s.merge(_spectrum(r))
        return pa.Table.from_batches([_row(rows[0]["task"] // fan, s)])

    while spectra.limit(2).count() > 1:
        level = spectra.groupBy(F.floor(F.col("task") / fan).alias("branch")).applyInArrow(merge, _SPECTRUM)
        spectra = materialize(level, "wh-level")
    last = spectra.first()
    return _spectrum(last) if last else None


def projected_covariance(fit: DataFrame, basis: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of all vectors, centred, in the columns of a basis; tasks send a triangle each."""
    k, dims = basis.shape[1], basis.shape[0]
    up = np.triu_indices(k)

    def run(batches):
        total, seen = np.zeros((k, k)), False
        for _, x in _slices(batches, dims):
            y = centred(x, n, sums) @ basis
            total, seen = total + y.T @ y, True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(up[0]), dtype=np.int32)), pa.array(total[up])], names=["at", "total"])

    out = np.zeros((k, k))
    for r in map_batches(fit.select("x"), run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        out[up[0][r["at"]], up[1][r["at"]]] = r["total"] / n
    return out + np.triu(out, 1).T


def refined(fit: DataFrame, basis: np.ndarray, n: int, sums: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and eigenvectors, by Rayleigh-Ritz steps over all vectors, at most `steps`.

    The last step is the first one that finds nothing off the diagonal beyond the rounding of its sums.
    """
    for _ in range(steps):
        basis, r = np.linalg.qr(basis)
        basis = basis * np.sign(np.where(np.diag(r) == 0, 1, np.diag(r)))
        h = projected_covariance(fit, basis, n, sums)
        off = np.abs(h - np.diag(np.diag(h))).max() if len(h) else 0.0
        values, turn = np.linalg.eigh(h)
        basis = basis @ turn
        if off <= 64 * np.finfo(np.float64).eps * max(np.trace(h), 0.0):
            break
    return values[::-1], basis[:, ::-1]


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS, add: int = ADD) -> Whitening:
    """The whitening of a table of distinct vectors (x)."""
    n, sums = fit_sums(fit, dims)
    whole = combined(materialize(partial_spectra(fit, dims, add), "wh-spectra"))
    values, vectors = refined(fit, whole.basis, n, sums)
    trace = float(values.sum())
    values, vectors = values[:components], vectors[:, :components]
    live = values > dims * np.finfo(np.float64).eps * max(trace, 0.0)
    values, vectors = np.where(live, values, 0.0), np.where(live, vectors, 0.0)
    scale = np.sqrt(np.where(live, values, 1.0))
    found = projected_covariance(fit, vectors / scale, n, sums)
    gap = np.abs(found - np.eye(len(values)))[np.ix_(live, live)]
    return Whitening(n, sums, vectors, values, trace, float(gap.max()) if gap.size else 0.0)


def whitened(rows: DataFrame, w: Whitening) -> DataFrame:
    """A row for each of rows (vec_id, x) and component."""
    dims, k = w.vectors.shape
    turned = w.vectors / np.sqrt(np.where(w.values > 0, w.values, 1.0))
    share = w.values / w.trace if w.trace > 0 else np.zeros(k)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch, x in _slices(batches, dims):
            m = len(x)
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), pa.array(w.deviation(x), pa.int64()).take(at), pa.array((w.centred(x) @ turned).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, w.identity_error))],
                names=names,
            )

    return map_batches(rows.select("vec_id", "x"), run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, add: int = ADD) -> tuple[DataFrame, Whitening | None]:
    """vec_id, component, n, deviation, whitened, explained and identity_error for usable rows of vectors (vec_id, embedding)."""
    held, dims = usable(vectors.select("vec_id", "embedding"))
    rows = held.select("vec_id", scaled("embedding", scale, MOST, add).alias("x"))
    if not dims:
        zero = F.lit(0.0)
        return rows.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), zero.alias("whitened"), zero.alias("explained"), zero.alias("identity_error")), None
    rows = materialize(rows, "wh-rows")
    w = fit_whitening(materialize(rows.select("x").distinct(), "wh-fit"), dims, components, add)
    return whitened(rows, w), w


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
