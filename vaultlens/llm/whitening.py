"""Whitening of embeddings by incremental eigendecomposition.

Each task keeps the mean and the spectrum of the scatter of its vectors and applies
every further vector as a centred rank-one update: the secular equation gives the new
eigenvalues, after deflation of what does not change. Spectra of tasks are combined in
a tree, again by successive rank-one updates. What comes out is the basis of a
Rayleigh-Ritz step over all vectors, which makes the components exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.tasks import batch_rows, prepare
from vaultlens.session import scratch_dir, ship_package

#: Components returned, and those a spectrum keeps (all, where vectors are shorter).
COMPONENTS, RANK = 8, 64
#: Whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Vectors of a batch, as a multiple of their entries, from which their factor is
#: taken first.
FACTOR_FROM = 4
#: States that one task combines.
FAN_IN = 16
#: Passes of refinement at most, and the residual, relative to the first eigenvalue,
#: at which they end. Whole spectra need one pass.
PASSES, RESIDUAL = 40, 1e-12
#: Eigenvalues below this share of the trace are no variance.
NO_VARIANCE = 1e-13

_EPS = np.finfo(float).eps


# -- rank-one updates ------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z', and their differences to every d.

    ``d`` ascends strictly and no ``z`` is 0. Every root lies between two poles and is
    found as an offset from the nearer one, by rational interpolation on both sides
    with bisection where that leaves the bracket. Row i of the differences belongs to
    root i: root - d[j].
    """
    n, square = len(d), z * z
    gap = np.append(np.diff(d), square.sum())
    middle = d + gap / 2
    right = (1 + (square / (d - middle[:, None])).sum(axis=1)) < 0
    right[-1] = False
    origin = np.where(right, np.append(d[1:], d[-1]), d)
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    delta = d - origin[:, None]
    left_side = np.tri(n)
    own = np.arange(n)
    beside = np.minimum(own + 1, n - 1)
    mu = (low + high) / 2
    for _ in range(60):
        away = delta - mu[:, None]
        terms = square / away
        slopes = terms / away
        psi, both = (terms * left_side).sum(axis=1), terms.sum(axis=1)
        slope_psi, slope_both = (slopes * left_side).sum(axis=1), slopes.sum(axis=1)
        f = 1 + both
        # as exact as the sum can be told
        found = np.abs(f) <= 8 * _EPS * (1 + both - 2 * psi)
        if found.all():
            break
        low, high = np.where(f < 0, mu, low), np.where(f < 0, high, mu)
        d1, d2 = away[own, own], away[own, beside]
        q, s = slope_psi * d1 * d1, (slope_both - slope_psi) * d2 * d2
        c = f - slope_psi * d1 - (slope_both - slope_psi) * d2
        a, b = c * (d1 + d2) + q + s, d1 * d2 * f
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step[-1] = d1[-1] + q[-1] / (f[-1] - slope_psi[-1] * d1[-1])
        new = mu + step
        inside = (new >= low) & (new <= high) & (new != 0)
        new = np.where(found, mu, np.where(inside, new, (low + high) / 2))
        if (np.abs(new - mu) <= 4 * _EPS * np.abs(new)).all():
            break
        mu = new
    return origin + mu, mu[:, None] - delta


class Spectrum:
    """Count, sums and mean of vectors, and eigenvalues and vectors of their scatter."""

    def __init__(self, size: int, rank: int = RANK):
        self.size, self.rank = size, min(rank, size)
        self.n, self.sums = 0, [0] * size
        self.mean, self.trace = np.zeros(size), 0.0
        self.values, self.vectors = np.zeros(0), np.zeros((size, 0))

    def add(self, vector: np.ndarray, times: int = 1) -> None:
        """A vector that occurs ``times`` times: one update centred on the running mean."""
        self._shift(vector, times)

    def add_all(self, rows: np.ndarray, times: np.ndarray) -> None:
        """Distinct vectors and how often each occurs.

        Many of them are first turned, without loss, into the triangular factor of
        their scatter around their own mean: as many updates as a vector has entries.
        """
        if len(rows) <= FACTOR_FROM * self.size:
            for row, n in zip(rows, times.tolist(), strict=True):
                self.add(row, n)
            return
        n = int(times.sum())
        # the mean as an offset from one of the vectors, which keeps its last bits
        mean = rows[0] + times @ (rows - rows[0]) / n
        factor = np.linalg.qr((rows - mean) * np.sqrt(times)[:, None], mode="r")
        for row in factor:
            self.update(row)
        self._shift(mean, n)

    def _shift(self, mean: np.ndarray, more: int) -> None:
        """The update for the means of two parts, and the mean of both."""
        off, n = mean - self.mean, self.n + more
        if self.n:
            self.update(off * np.sqrt(self.n * more / n))
        self.mean = self.mean + off * (more / n)
        self.n = n

    def merge(self, other: Spectrum) -> None:
        """Another spectrum, one rank-one update for each of its components and the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector * np.sqrt(value))
        self._shift(other.mean, other.n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def update(self, v: np.ndarray) -> None:
        """The spectrum of scatter + v v'."""
        d, q = self.values, self.vectors
        z = v @ q
        if q.shape[1] < self.size:
            rest = v - q @ z
            rest -= q @ (rest @ q)
            length = float(np.linalg.norm(rest))
            if length > 1e-12 * float(np.linalg.norm(v)):
                q = np.column_stack((rest / length, q))
                d, z = np.append(0.0, d), np.append(length, z)
        if not len(d):
            return
        order = np.argsort(d, kind="stable")
        d, z, q = d[order], z[order], q[:, order]
        tiny = 8 * _EPS * max(float(d[-1]), float(z @ z))
        # clusters of equal values: a reflection leaves one of them with all of z
        starts = np.flatnonzero(np.append(True, np.diff(d) > tiny))
        if len(starts) < len(d):
            q, z = q.copy(), z.copy()
            for a, e in zip(starts, np.append(starts[1:], len(d)), strict=True):
                if e - a > 1:
                    w = z[a:e].copy()
                    length = np.linalg.norm(w)
                    w[-1] += np.copysign(length, w[-1])
                    if (norm := w @ w) > 0:
                        q[:, a:e] -= np.outer(q[:, a:e] @ w, w) * (2 / norm)
                        z[e - 1], z[a : e - 1] = -np.copysign(length, z[e - 1]), 0.0
        live = np.abs(z) * np.linalg.norm(z) > tiny
        if live.any():
            dl, zl = d[live], z[live]
            roots, off = secular_roots(dl, zl)
            # the z for which these roots are exact keeps the vectors orthogonal
            gaps = dl[:, None] - dl
            np.fill_diagonal(gaps, 1.0)
            exact = np.copysign(np.sqrt(np.abs(np.prod(off / gaps, axis=0))), zl)
            turn = exact / off
            turn /= np.linalg.norm(turn, axis=1)[:, None]
            d, q = d.copy(), q.copy()
            d[live], q[:, live] = roots, q[:, live] @ turn.T
        if len(d) > self.rank:
            order = np.argsort(d, kind="stable")[len(d) - self.rank :]
            d, q = d[order], q[:, order]
        self.values, self.vectors = d, q


# -- distributed passes ------------------------------------------------------------

_STATE_DDL = "slot long, state binary"


def _written(frame: DataFrame, purpose: str) -> DataFrame:
    folder = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def _states(items: Iterator[tuple[int, object]]) -> Iterator[pa.RecordBatch]:
    for slot, item in items:
        columns = [pa.array([slot], pa.int64()), pa.array([pickle.dumps(item)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "state"])


def combined(states: DataFrame, merge: Callable):
    """One state of all, combined in a tree of tasks; None where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged():
            slot, held = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    state = pickle.loads(row["state"])
                    if row["slot"] == slot:
                        held = merge(held, state)
                    else:
                        if held is not None:
                            yield slot, held
                        slot, held = row["slot"], state
            if held is not None:
                yield slot, held

        yield from _states(merged())

    states = _written(states, "whitening-states")
    n = states.count()
    while n > 1:
        slots = -(-n // FAN_IN)
        dealt = states.select(F.pmod(F.xxhash64("state"), F.lit(slots)).alias("slot"), "state")
        dealt = dealt.repartition(slots, "slot").sortWithinPartitions("slot", "state")
        states = _written(dealt.mapInArrow(run, _STATE_DDL), "whitening-states")
        n = states.count()
    row = states.first()
    return pickle.loads(row["state"]) if row else None


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def spectrum_of(vectors: DataFrame, size: int, rank: int = RANK) -> Spectrum | None:
    """The combined spectrum of a table of whole-number vectors ``x``."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(size, rank)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, times = np.unique(_matrix(batch, size), axis=0, return_counts=True)
            # halves of 32 bits add up without overflow
            for half, weight in ((rows >> 32, 1 << 32), (rows & 0xFFFFFFFF, 1)):
                own.sums = [s + weight * int(m) for s, m in zip(own.sums, times @ half, strict=True)]
            own.add_all(rows.astype(float), times)
        if own.n:
            yield from _states(iter([(0, own)]))

    def merge(a: Spectrum, b: Spectrum) -> Spectrum:
        a.merge(b)
        return a

    return combined(vectors.select("x").mapInArrow(fit, _STATE_DDL), merge)


def _exact_offsets(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: as long where that fits, else as Python numbers."""
    top = int(max(abs(int(rows.max())), abs(int(rows.min())))) if rows.size else 0
    if top * n + max(abs(s) for s in sums) < 1 << 62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def _product(vectors: DataFrame, size: int, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance times a basis, and the trace, centred before multiplying."""
    shared = vectors.sparkSession.sparkContext.broadcast((n, sums, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis = shared.value
        total, trace, seen = np.zeros((size, basis.shape[1])), 0.0, False
        for batch in batches:
            off = _exact_offsets(_matrix(batch, size), n, sums).astype(float) / n
            total += off.T @ (off @ basis)
            trace += float((off * off).sum())
            seen = True
        if seen:
            yield from _states(iter([(0, (total, trace))]))

    total, trace = combined(vectors.select("x").mapInArrow(run, _STATE_DDL), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    shared.unpersist()
    return total / n, trace / n


def _ritz(product: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inner = basis.T @ product
    values, turns = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], turns[:, ::-1]


def refined(vectors: DataFrame, found: Spectrum, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, vectors and trace of the covariance, by Rayleigh-Ritz over all vectors.

    A whole basis is exact after one pass. A truncated one is extended by the residuals
    and by the last change of its vectors until the residuals vanish.
    """
    size = found.size
    basis, before = np.linalg.qr(found.vectors[:, ::-1])[0] if found.vectors.size else np.eye(size), None
    if size <= found.rank:
        basis = np.linalg.qr(np.column_stack((basis, np.eye(size))))[0][:, :size]
    for _ in range(PASSES):
        product, trace = _product(vectors, size, found.n, found.sums, basis)
        values, turns = _ritz(product, basis)
        ritz = basis @ turns
        top = min(components, size)
        rest = product @ turns - ritz * values
        if basis.shape[1] == size or np.linalg.norm(rest[:, :top], axis=0).max() <= RESIDUAL * abs(values[0]):
            break
        kept = ritz[:, : found.rank]
        more = [kept, rest[:, : 2 * top]]
        if before is not None:
            more.append((before - kept @ (kept.T @ before))[:, : 2 * top])
        before = kept
        joined = np.column_stack(more)
        joined = joined / np.maximum(np.linalg.norm(joined, axis=0), 1e-300)
        basis, weights = np.linalg.qr(joined)
        basis = basis[:, np.abs(np.diag(weights)) > 1e-10][:, :size]
        basis = np.linalg.qr(basis)[0]
    ritz, values = ritz[:, :top], values[:top]
    signs = np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(top)])
    return np.maximum(values, 0.0), ritz * signs, trace


# -- the operator ---------------------------------------------------------------------


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is usable: no null and only finite entries."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = embeddings.select("vec_id", F.col(vector).cast("array<double>").alias(vector))
    rows = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    top = F.lit((1 << 63) - 1 - SHIFT)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(vector, lambda c: F.least(F.floor(c * SCALE), top) + SHIFT).alias("x"),
    )


_OUT_DDL = "vec_id long, n long, deviation long, whitened array<double>"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, rank: int = RANK, vector: str = "embedding") -> DataFrame:
    """One row for each usable vector and component, with the figures of the fit.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out,
    and so are vectors of another length than the commonest (of equally common lengths
    the largest), as one covariance has one size. Null and repeated ids are only
    carried along; repeated rows count each. Without rows the result is empty. Entries
    beyond a long end at its ends, and a deviation beyond a long is null. A component
    without variance has 0 for ``whitened`` and is no part of ``identity_error``.
    """
    spark = ship_package(prepare(embeddings.sparkSession))
    vectors = _written(whole_numbers(embeddings, vector), "whitening-vectors")
    lengths = vectors.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    commonest = lengths.first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if commonest is None:
        return spark.createDataFrame([], schema)
    size = commonest["size"]
    vectors = vectors.filter(F.size("x") == size)
    with batch_rows(spark, 8192):
        found = spectrum_of(vectors, size, rank)
        values, turns, trace = refined(vectors, found, components)
        varied = values > NO_VARIANCE * trace
        scale = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)
        shared = spark.sparkContext.broadcast((found.n, found.sums, turns * scale))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums, turns = shared.value
            for batch in batches:
                off = _exact_offsets(_matrix(batch, size), n, sums)
                if off.dtype == object or size * int(np.abs(off).max(initial=0)) ** 2 >= 1 << 63:
                    squares = [sum(int(v) ** 2 for v in row) for row in off]
                    squares = [s if s < 1 << 63 else None for s in squares]
                else:
                    squares = (off * off).sum(axis=1)
                white = (off.astype(float) / n) @ turns
                width = turns.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id"),
                        pa.array(np.full(len(off), n), pa.int64()),
                        pa.array(squares, pa.int64()),
                        pa.ListArray.from_arrays(np.arange(0, len(off) * width + 1, width, dtype=np.int32), white.ravel()),
                    ],
                    ["vec_id", "n", "deviation", "whitened"],
                )

        rows = _written(vectors.mapInArrow(project, _OUT_DDL), "whitening-rows")
    error = _identity_error(rows, np.flatnonzero(varied), found.n)
    explained = [float(v / trace) if trace > 0 else 0.0 for v in values]
    return rows.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(F.array(*(F.lit(v) for v in explained)), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _identity_error(rows: DataFrame, used: np.ndarray, n: int) -> float:
    """Largest entry of the covariance of the whitened values minus the identity."""
    w = [F.col("whitened")[int(k)] for k in used]
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    if not pairs:
        return 0.0
    sums = rows.agg(
        *(F.sum(c).alias(f"s{i}") for i, c in enumerate(w)),
        *(F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs),
    ).first()
    return max(abs(sums[f"p{i}_{j}"] / n - sums[f"s{i}"] * sums[f"s{j}"] / n / n - (i == j)) for i, j in pairs)
