from __future__ import annotations

import math

import numpy as np
import pytest

from vaultlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component int"


def frame(spark, vectors):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, 3) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def check(found, vectors, components=8):
    """All columns against a plain eigendecomposition of the same whole numbers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in vectors if usable(v)]
    x = np.array([v for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    off = ((n * x - sums) / n).astype(float)
    covariance = off.T @ off / n
    values, turns = np.linalg.eigh(covariance)
    values, turns = values[::-1][:components], turns[:, ::-1][:, :components]
    rows = {}
    for r in found:
        rows.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    assert len(found) == n * min(components, x.shape[1])
    white = np.zeros((n, len(values)))
    for k, (i, v) in enumerate(kept):
        deviation = sum(int(n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        own = rows[i, deviation]
        assert sorted(own) == list(range(1, len(values) + 1))
        white[k] = [own[c + 1]["whitened"] for c in range(len(values))]
        for c, value in enumerate(values):
            assert own[c + 1]["n"] == n
            assert abs(own[c + 1]["explained"] - value / covariance.trace()) <= 1e-9 * value / covariance.trace()
            assert 0 <= own[c + 1]["identity_error"] <= 1e-9
    wanted = off @ turns / np.sqrt(values)
    signs = np.sign((white * wanted).sum(axis=0))
    assert np.abs(white - wanted * signs).max() < 1e-6
    assert np.abs(np.cov(white.T, bias=True) - np.eye(len(values))).max() < 1e-9


@pytest.mark.parametrize("seed", range(12))
def test_secular_roots_equal_eigenvalues(seed):
    pick = np.random.default_rng(seed)
    n = int(pick.integers(1, 40))
    d = np.cumsum(10.0 ** pick.uniform(-8 if seed % 2 else -1, 2, n))
    z = pick.normal(size=n) * 10.0 ** pick.uniform(-4, 2, n)
    roots, off = whitening.secular_roots(d, z)
    wanted = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.abs(roots - wanted).max() <= 1e-13 * wanted.max()
    assert np.allclose(off, roots[:, None] - d, rtol=1e-6, atol=1e-12 * wanted.max())


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("at_once", [False, True])
def test_spectrum_equals_that_of_the_scatter(equal, at_once):
    pick = np.random.default_rng(5)
    rows = np.round(pick.normal(size=(300, 12)) * pick.uniform(1, 200, 12) + 100_000)
    if equal:
        rows[50:200] = rows[7]
        rows[:, 3] = 5.0
    parts = []
    for part in np.array_split(rows, 4):
        own = whitening.Spectrum(12)
        if at_once:
            own.add_all(*np.unique(part, axis=0, return_counts=True))
        else:
            for row in part:
                own.add(row)
        parts.append(own)
    whole = parts[0]
    for part in parts[1:]:
        whole.merge(part)
    off = rows - rows.mean(axis=0)
    scatter = off.T @ off
    assert whole.n == 300 and np.allclose(whole.mean, rows.mean(axis=0), rtol=1e-13)
    q = whole.vectors
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-10
    assert np.abs(q * whole.values @ q.T - scatter).max() < 1e-9 * np.trace(scatter)


def test_given_embeddings(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in given.collect()]
    check(whitening.whiten(given.repartition(40)).collect(), vectors)


def test_truncated_spectra_are_refined_to_the_same(spark):
    pick = np.random.default_rng(2)
    vectors = [(i, (pick.normal(size=40) * np.linspace(0.05, 1, 40)).tolist()) for i in range(300)]
    check(whitening.whiten(frame(spark, vectors).repartition(5), components=3, rank=6).collect(), vectors, 3)


def test_edge_rows(spark):
    pick = np.random.default_rng(1)
    vectors = [(i, (pick.normal(size=10)).tolist()) for i in range(60)]
    vectors += [(3, vectors[3][1])] * 30 + [(None, vectors[5][1]), (None, pick.normal(size=10).tolist())]
    bad = [(100, None), (101, []), (102, [1.0] * 9 + [None]), (103, [float("nan")] * 10), (104, [float("inf")] + [0.0] * 9)]
    other = [(105, [1.0, 2.0])]
    check(whitening.whiten(frame(spark, vectors + bad + other).repartition(3)).collect(), vectors)
    assert whitening.whiten(frame(spark, bad)).collect() == []
    assert whitening.whiten(frame(spark, [])).columns == whitening.whiten(frame(spark, vectors)).columns


def test_no_variance_and_huge_entries(spark):
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0)]
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    found = whitening.whiten(frame(spark, line)).collect()
    assert all(r["whitened"] == 0.0 for r in found if r["component"] > 1)
    assert all(abs(r["explained"] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in found if r["component"] == 1)
    huge = [(i, [1e30 * (-1) ** i, 1e15 * i]) for i in range(4)]
    assert all(r["deviation"] is None for r in whitening.whiten(frame(spark, huge)).collect())
