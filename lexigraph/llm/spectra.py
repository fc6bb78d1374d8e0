"""Eigendecompositions that grow by rank-one updates: secular equations with deflation, in numpy."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(np.float64).eps


@functools.lru_cache(maxsize=256)
def _sides(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a k by k matrix on or above the diagonal, those below, and its diagonal's indexes."""
    at = np.arange(k)
    up = at[:, None] <= at[None, :]
    return up, ~up, at


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """gap[j, i] = poles[j] - root[i] of 1 + sum_j weights[j] / (poles[j] - x) = 0, one root above each pole.

    poles rise and differ, weights are positive. All roots are sought at once: each is measured from the nearer of
    the poles beside it, so that small differences stay exact, and its two sums, over the poles below and above, are
    replaced by a pole each that has their values and slopes; a step out of the bracket halves it instead.
    """
    k = len(poles)
    top = poles[-1] + weights.sum()
    width = np.append(poles[1:], top) - poles
    gaps = poles[:, None] - poles[None, :]
    below, above, at = _sides(k)
    half = 1 + (weights[:, None] / (gaps - width / 2)).sum(0)
    left = half >= 0
    left[-1] = True
    origin = np.where(left, at, np.minimum(at + 1, k - 1))
    delta = poles[:, None] - poles[origin][None, :]
    low_weights, high_weights = weights[:, None] * below, weights[:, None] * above
    low, high = np.where(left, 0.0, -width / 2), np.where(left, width / 2, 0.0)
    if half[-1] < 0:
        low[-1], high[-1] = width[-1] / 2, width[-1]
    tau = (low + high) / 2
    own = delta.diagonal()
    upper = np.append(delta.diagonal(-1), 0.0)
    done = np.zeros(k, bool)
    for _ in range(80):
        inverse = 1 / (delta - tau)
        psi, phi = np.einsum("ji,ji->i", low_weights, inverse), np.einsum("ji,ji->i", high_weights, inverse)
        inverse *= inverse
        psi_slope, phi_slope = np.einsum("ji,ji->i", low_weights, inverse), np.einsum("ji,ji->i", high_weights, inverse)
        f = 1 + psi + phi
        done |= np.abs(f) <= 2 * _EPS * k * (1 + np.abs(psi) + np.abs(phi))
        if done.all():
            break
        high, low = np.where(f > 0, tau, high), np.where(f > 0, low, tau)
        x, y = own - tau, upper - tau
        c = f - psi_slope * x - phi_slope * y
        a, b = c * (x + y) + psi_slope * x * x + phi_slope * y * y, f * x * y
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(0, a * a - 4 * b * c))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step[-1] = x[-1] + psi_slope[-1] * x[-1] ** 2 / (1 + psi[-1] - psi_slope[-1] * x[-1])
        new = tau + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done |= (new == tau) | (high - low <= _EPS * np.maximum(np.abs(low), np.abs(high)))
        tau = np.where(done, tau, new)
    return delta - tau


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) of basis diag(values) basis' + v v'.

    Directions that v does not touch keep their pair, and of directions with one eigenvalue a reflection leaves a
    single one that v touches (deflation); the roots of the secular equation are the eigenvalues of the others, whose
    vectors come from weights that fit the roots found, so they are orthogonal.
    """
    z = basis.T @ v
    size = z @ z
    if not size:
        return values, basis
    tiny = 8 * _EPS * max(values[-1], size)
    basis = basis.copy()
    same = np.flatnonzero(np.diff(values) > tiny) + 1
    if len(same) < len(values) - 1:
        for group in (g for g in np.split(np.arange(len(values)), same) if len(g) > 1):
            u, length = z[group], np.linalg.norm(z[group])
            if length:
                end = -np.copysign(length, u[-1])
                u[-1] -= end
                basis[:, group] -= np.outer(basis[:, group] @ u, u * (2 / (u @ u)))
                z[group] = 0
                z[group[-1]] = end
    active = np.flatnonzero(np.abs(z) * np.sqrt(size) > tiny)
    if not len(active):
        return values, basis
    poles, own = values[active], z[active]
    gap = secular_roots(poles, own * own)
    k = len(poles)
    # the weights for which these roots are exact: (root_i - pole_j) over (pole_i - pole_j), neighbours paired
    pairs = poles[None, :] - poles[:, None]
    up, down, at = _sides(k)
    upper = np.where(up[:, : k - 1], -pairs[:, 1:], 1.0)
    ratio = gap[:, : k - 1] / np.where(down[:, : k - 1], -pairs[:, : k - 1], upper)
    weights = np.abs(gap[:, -1] * ratio.prod(1))
    vectors = np.copysign(np.sqrt(weights), own)[:, None] / gap
    vectors /= np.linalg.norm(vectors, axis=0)
    values = values.copy()
    values[active] = poles - gap.diagonal()
    basis[:, active] = basis[:, active] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Number, mean, and the eigenpairs of the scatter (sum of centred squares) of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def add(self, x: np.ndarray) -> None:
        """One more vector: a rank-one update by its centred difference from the mean."""
        gap = x - self.mean
        self.n += 1
        self.mean = self.mean + gap / self.n
        self.values, self.basis = rank_one(self.values, self.basis, gap * np.sqrt((self.n - 1) / self.n))

    def merge(self, other: Spectrum) -> None:
        """The vectors of another spectrum: an update for each of its pairs, and one for the difference of the means."""
        if not other.n:
            return
        gap, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.basis.T):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, np.sqrt(value) * vector)
        self.values, self.basis = rank_one(self.values, self.basis, gap * np.sqrt(self.n * other.n / n))
        self.mean, self.n = self.mean + gap * (other.n / n), n
