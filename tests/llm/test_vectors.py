"""Compression and whitening of vectors against brute force, with awkward rows, and the numerics alone."""

import hashlib
import math

import numpy as np
import pytest

from lexigraph.llm import grid_codes, spectra, whitening

R = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, n long, component string, `task` string"
DIMS = 20


def rows():
    base = R.normal(0, 0.2, (150, DIMS)).astype(np.float32)
    base[7] = base[3]
    base[20:60] = base[19]  # a hot vector
    base[70, 4] = 9.5
    out = [(i, v.tolist(), int(i % 3) if i % 7 else None) for i, v in enumerate(base)]
    out += [(200, None, 1), (201, base[0].tolist()[:-1] + [None], 1), (202, base[1].tolist()[:-1] + [math.nan], 2), (203, [math.inf] + base[1].tolist()[1:], 2)]
    out += [(204, [], 1), (205, [0.5], 1), (None, base[5].tolist(), 0), (3, base[8].tolist(), 0), (3, base[9].tolist(), None)]
    return [r + ("x", "c", 5, "k", "t") for r in out]


ROWS = rows()
USABLE = [r for r in ROWS if r[1] and len(r[1]) == DIMS and all(v is not None and math.isfinite(v) for v in r[1])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def plain_codes(used, parts, entries, rounds, scale):
    """Codebooks and, for each row, code and error by measuring all entries."""
    filled = -(-len(used[0][1]) // parts) * parts
    x = np.zeros((len(used), filled), np.int64)
    for i, r in enumerate(used):
        x[i, : len(r[1])] = [math.floor(scale * v) for v in r[1]]
    order = sorted(range(len(used)), key=lambda i: (used[i][0] is None, used[i][0] or 0, x[i].tolist()))
    books = [[x[i, p * filled // parts : (p + 1) * filled // parts].tolist() for i in order[:entries]] for p in range(parts)]
    step = filled // parts

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p]))

    cut = [[x[i, p * step : (p + 1) * step].tolist() for p in range(parts)] for i in range(len(used))]
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for i in range(len(used)):
                mine.setdefault(nearest(p, cut[i][p])[1], []).append(cut[i][p])
            for k, own in mine.items():
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = [[nearest(p, cut[i][p]) for p in range(parts)] for i in range(len(used))]
    return books, ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found]


@pytest.mark.parametrize(("parts", "entries", "bits"), [(8, 16, 9), (4, 16, 3), (5, 3, 12), (8, 400, 7)])
def test_codes_equal_plain_search(vectors, parts, entries, bits):
    got, books = grid_codes.compress(vectors, parts=parts, entries=entries, bits=bits)
    want_books, codes, errors = plain_codes(USABLE, parts, entries, 6, 4096)
    assert books.tolist() == want_books
    want = sorted((str(r[0]), str(r[2]), c, e) for r, c, e in zip(USABLE, codes, errors))
    assert sorted((str(r["vec_id"]), str(r["label"]), r["code"], r["error"]) for r in got.collect()) == want


def test_query_columns(spark, tmp_path, vectors):
    vectors.select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    books, codes, errors = plain_codes(USABLE, 8, 16, 6, 4096)
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    by_label = {}
    for r, e in zip(USABLE, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    want = sorted((str(r[0]), c, e, by_label[r[2]], digest) for r, c, e in zip(USABLE, codes, errors))
    assert sorted((str(r["vec_id"]), *r[1:]) for r in grid_codes.op11(spark, str(tmp_path)).collect()) == want


def test_remembered_cells_never_hide_the_nearest():
    """Small caches, equal hashes and ties, in many batches against all distances."""
    book = R.integers(-40, 40, (16, 3))
    book[9] = book[2]
    for most in (0, 5, 1 << 16):
        cells = grid_codes.Cells(book, 3, most)
        for _ in range(20):
            x = R.integers(-60, 60, (200, 3))
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            entry, distance = cells.nearest(x)
            assert (entry == d.argmin(1)).all() and (distance == d.min(1)).all()
        assert len(cells.keys) <= most
    cells.cells[:] = 99  # every remembered cell belongs to another one with the same hash
    entry, _ = cells.nearest(x)
    assert (entry == d.argmin(1)).all()


def test_dominated_entries_are_left_out():
    cells = grid_codes.Cells(np.array([[0, 0], [100, 100], [3, 3]]), 2)
    assert cells.open_entries(np.array([[0, 0], [25, 25]])).tolist() == [[True, False, True], [False, True, False]]


def test_decoding_gives_entries(spark, vectors):
    got, books = grid_codes.compress(vectors, parts=4)
    for r in grid_codes.decoded(got, books).limit(5).collect():
        want = [v / 4096 for p in range(4) for v in books[p][int(r["code"][2 * p : 2 * p + 2], 16)].tolist()]
        assert r["approx"] == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert grid_codes.compress(none)[0].collect() == [] and whitening.whiten(none)[0].collect() == []
    void = spark.createDataFrame([(1, None, 1, "x", "c", 5, "k", "t")], SCHEMA)
    assert grid_codes.compress(void)[0].collect() == [] and whitening.whiten(void)[0].collect() == []


@pytest.mark.parametrize("kind", ["plain", "whole", "equal", "flat", "wide", "one"])
def test_rank_one_updates_hold_the_scatter(kind):
    x = R.normal(0, 8, (300, 1 if kind == "one" else 24))
    x = {"whole": np.floor(x / 6), "equal": np.repeat(x[:4], 75, axis=0), "flat": x[:, :1] @ R.normal(0, 1, (1, 24)) if kind == "flat" else x, "wide": x * np.logspace(4, -4, x.shape[1])}.get(kind, x)
    c = x - x.mean(0)
    scatter = c.T @ c
    one, two = spectra.Spectrum.empty(x.shape[1]), spectra.Spectrum.empty(x.shape[1])
    for v in x[:100]:
        one.add(v)
    for v in x[100:]:
        two.add(v)
    one.merge(two)
    assert one.n == 300 and np.allclose(one.mean, x.mean(0))
    assert np.abs((one.basis * one.values) @ one.basis.T - scatter).max() <= 1e-12 * np.abs(scatter).max()
    assert np.abs(one.basis.T @ one.basis - np.eye(x.shape[1])).max() < 1e-11
    assert np.abs(one.values - np.linalg.eigvalsh(scatter)).max() <= 1e-12 * one.values[-1]


def test_secular_roots_lie_between_poles():
    poles = np.array([0.0, 1.0, 1.0 + 1e-9, 5.0])
    weights = np.array([1e-12, 0.5, 1e-3, 2.0])
    gap = spectra.secular_roots(poles, weights)
    roots = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(poles - gap.diagonal(), roots, atol=1e-14)
    assert (gap.diagonal() < 0).all() and (gap[np.arange(1, 4), np.arange(3)] > 0).all()


def exact(used):
    x = [[math.floor(64 * v) + 1_000_000 for v in r[1]] for r in used]
    fit = np.array(sorted({tuple(v) for v in x}))
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    return x, fit, n, s, c.T @ c / n


def test_whitening_equals_a_whole_decomposition(vectors):
    got = whitening.whiten(vectors)[0].collect()
    x, fit, n, s, v = exact(USABLE)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    want = ((np.array(x) * n - s) / n) @ basis / np.sqrt(values)
    assert len(got) == len(USABLE) * 16 and {r["n"] for r in got} == {n}
    table = {}
    for r in got:
        table.setdefault((str(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    sign = None
    for r, own, white in zip(USABLE, x, want):
        mine = table[str(r[0]), sum((n * a - int(b)) ** 2 for a, b in zip(own, s))]
        have = np.array([mine[k][0] for k in range(1, 17)])
        sign = np.sign(have * white) if sign is None else sign
        assert np.allclose(have, white * sign, atol=1e-9)
    shares = {r["component"]: r["explained"] for r in got}
    assert np.allclose([shares[k] for k in range(1, 17)], values / np.trace(v), rtol=1e-9)
    assert {r["identity_error"] < 1e-10 for r in got} == {True}


def test_spectra_meet_in_a_tree(spark):
    x = R.integers(-50, 50, (200, 6))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(9)
    whole = whitening.combined(whitening.materialize(whitening.partial_spectra(fit, 6, 0), "t"), fan=2)
    c = x - x.mean(0)
    assert whole.n == 200 and np.allclose(whole.values, np.linalg.eigvalsh(c.T @ c)) and np.allclose(whole.mean, x.mean(0))


def test_refinement_mends_a_poor_basis(spark):
    x = R.integers(-50, 50, (100, 5))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(3)
    n, s = whitening.fit_sums(fit, 5)
    values, basis = whitening.refined(fit, np.eye(5) + 0.3 * R.normal(0, 1, (5, 5)), n, s)
    c = x - x.mean(0)
    assert np.allclose(values, np.linalg.eigvalsh(c.T @ c / 100)[::-1], rtol=1e-13)
    assert np.allclose(np.abs(basis.T @ np.linalg.eigh(c.T @ c)[1][:, ::-1]), np.eye(5), atol=1e-12)


def test_whitening_without_variance_and_beyond_longs(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(one)[0].collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, 0.0, 0.0, 0.0)] * 4
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    by = {(r["vec_id"], r["component"]): r for r in whitening.whiten(line)[0].collect()}
    assert abs(abs(by[4, 1]["whitened"]) - math.sqrt(2)) < 1e-12 and by[4, 2]["whitened"] == by[4, 3]["whitened"] == 0.0
    assert by[4, 1]["identity_error"] < 1e-10 and abs(by[0, 1]["explained"] - 1) < 1e-12
    far = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(far)[0].collect()} == {0: None, 1: None, 2: 64**2 * 9}
