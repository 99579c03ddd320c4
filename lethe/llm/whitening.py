"""Embedding whitening by spectrum slicing.

1. Two passes over the vectors give the exact sums and the covariance of the shifted
   integers x = floor(scale * c) + offset.  A task sends one packed partial; partials meet
   in ``MERGE`` streams, so the driver sees at most that many d x d blocks.
2. On the d x d covariance (a model, not data) the eigenvalues above a shift are counted
   as positive pivots of the LDL' factorisation of the shifted matrix (Sylvester).  Slicing
   [0, trace] by these counts isolates each leading eigenvalue; Rayleigh quotient iteration
   then converges cubically inside the isolating slice, and counts just above and below the
   value certify its number.
3. A third pass measures the covariance of the whitened vectors, a fourth writes them.

Defined results: a vector that is null or holds a null, NaN or infinite entry is dropped;
vectors of another length than most (ties: the longer) are dropped as well; entries beyond
2**52 / scale count as that bound; null and repeated ids keep their rows; components whose
eigenvalue is below ``RANK_TOL`` of the trace cannot be whitened and are left out, so equal
vectors, a single vector and an empty table give no rows; equal eigenvalues get an
orthonormal basis of their space; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

MERGE = 64                     # streams that merge the partials of the tasks
RANK_TOL = 1e-12
_EPS = np.finfo(float).eps
_SPLIT = 26                    # sums are kept as two parts of this many bits
_STEP = 4096                   # vectors a NumPy pass takes


# Factorisation and slicing ----------------------------------------------------------
class Factor:
    """Bunch-Parlett LDL' of a - shift I: pivots of order 1 or 2, complete pivoting; a pivot lost
    in the rounding of ``a`` counts as not positive."""

    def __init__(self, a: np.ndarray, shift: float):
        d = len(a)
        tiny = _EPS * max(np.abs(a).max(), abs(shift))
        a = a - shift * np.eye(d)
        self.perm, self.low, self.blocks = np.arange(d), np.eye(d), []
        self.positive = 0
        k = 0
        while k < d:
            rest = np.abs(a[k:, k:])
            diag = int(np.argmax(rest.diagonal()))
            one = k + 1 == d or rest[diag, diag] >= 0.6404 * rest.max()   # (1 + sqrt 17) / 8
            if one:
                self._swap(a, k, k + diag)
                p = a[k, k]
                p = p if abs(p) > tiny else -tiny
                self.positive += bool(p > 0)
                self.blocks.append((k, np.array([[p]])))
                m = a[k + 1:, k:k + 1] / p
                a[k + 1:, k + 1:] -= m * a[k, k + 1:]
                self.low[k + 1:, k:k + 1] = m
            else:
                i, j = sorted(divmod(int(np.argmax(np.triu(rest, 1))), d - k))
                self._swap(a, k, k + i)
                self._swap(a, k + 1, k + j)
                e = a[k:k + 2, k:k + 2].copy()
                self.positive += 1                 # its determinant is negative: one of either sign
                self.blocks.append((k, e))
                m = np.linalg.solve(e, a[k:k + 2, k + 2:]).T
                a[k + 2:, k + 2:] -= m @ a[k:k + 2, k + 2:]
                self.low[k + 2:, k:k + 2] = m
            k += 1 if one else 2

    def _swap(self, a, i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.perm[[i, j]] = self.perm[[j, i]]
            self.low[[i, j], :i] = self.low[[j, i], :i]

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.perm].copy()
        for k in range(len(y)):
            y[k + 1:] -= self.low[k + 1:, k] * y[k]
        for k, e in self.blocks:
            y[k:k + len(e)] = np.linalg.solve(e, y[k:k + len(e)])
        for k in range(len(y) - 1, -1, -1):
            y[:k] -= self.low[k, :k] * y[k]
        out = np.empty_like(y)
        out[self.perm] = y
        return out


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``a`` above ``shift``."""
    return Factor(a, shift).positive


def slices(a: np.ndarray, k: int, top: float) -> list[tuple[float, float, int, int]]:
    """(lo, hi, first, last): slices of [0, top] from above, each with the eigenvalues numbered
    first..last; more than one only where they lie within rounding of each other."""
    d, out = len(a), []
    tol = 4 * d * _EPS * top
    todo = [(-tol, top + tol, d, 0)]
    while todo:
        lo, hi, below, over = todo.pop()
        if over >= k or below == over:
            continue
        if below - over == 1 or hi - lo <= tol:
            out.append((lo, hi, over + 1, below))
            continue
        mid = (lo + hi) / 2
        c = above(a, mid)
        todo += [(lo, mid, below, c), (mid, hi, c, over)]
    return sorted(out, key=lambda s: s[2])


def _unit(v: np.ndarray, found: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - found @ (found.T @ v)
    return v / np.linalg.norm(v)


def _eigenpair(a, lo, hi, number, alone, found, tol):
    """Rayleigh quotient iteration kept inside the slice (lo, hi); a quotient that leaves it
    halves the slice by one more count."""
    d = len(a)
    start = np.random.default_rng(number).standard_normal(d)
    for _ in range(200):
        q = _unit(start, found)
        near = Factor(a, (lo + hi) / 2)
        for _ in range(2):
            q = _unit(near.solve(q), found)
        for _ in range(10):
            value = q @ a @ q
            if np.linalg.norm(a @ q - value * q) <= tol:
                q = _unit(Factor(a, value).solve(q), found)
                return float(q @ a @ q), q
            if alone and not lo < value < hi:
                break
            q = _unit(Factor(a, value).solve(q), found)
        if alone:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if near.positive >= number else (lo, mid)
        start = q + _unit(np.random.default_rng(number + d).standard_normal(d), found) / 8
    raise ArithmeticError(f"eigenvalue {number} did not converge")


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues (fewer if the rank is less) and their unit eigenvectors."""
    d, top = len(a), float(np.trace(a))
    if top <= 0:
        return np.empty(0), np.empty((d, 0))
    k = min(k, above(a, RANK_TOL * top))
    tol = 8 * d * _EPS * top
    values, found = [], np.empty((d, 0))
    for lo, hi, first, last in slices(a, k, top):
        here = []
        for number in range(first, last + 1):
            value, q = _eigenpair(a, lo, hi, number, first == last, found, tol)
            found = np.column_stack([found, q])
            here.append((value, q))
        here.sort(key=lambda x: -x[0])
        found[:, first - 1:last] = np.column_stack([q for _, q in here])
        values += [v for v, _ in here]
    for number, v in enumerate(values, 1):
        if not above(a, v + 2 * tol) < number <= above(a, v - 2 * tol):
            raise ArithmeticError(f"counts do not certify eigenvalue {number}")
    return np.array(values[:k]), found[:, :k]


# Passes over the vectors ----------------------------------------------------------------
@dataclass(frozen=True)
class Whitening:
    """Mean (as exact sums over n), components (d x k), their eigenvalues and share of the trace."""
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    scale: float
    offset: int

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n * x - S) exactly (int64, or Python integers where those pass 63 bits) and as
        doubles over n."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62:
            dev = x * self.n - np.array(self.sums, dtype=np.int64)
            return dev, dev / self.n
        dev = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return dev, (dev / self.n).astype(float)

    def whiten(self, z: np.ndarray) -> np.ndarray:
        return z @ self.components / np.sqrt(self.values)


def _batches(batches, scale, offset):
    """(ids or None, x as int64) of the usable vectors, by length, in bounded steps."""
    for whole in batches:
        for at in range(0, whole.num_rows, _STEP):
            b = whole.slice(at, _STEP)
            vec = b.column(b.num_columns - 1)
            sizes = np.diff(vec.offsets.to_numpy())
            null = vec.is_null().to_numpy(zero_copy_only=False)
            flat = vec.values.slice(vec.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False).astype(float)
            first = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes[~null & (sizes > 0)]).tolist():
                rows = np.flatnonzero(~null & (sizes == d))
                c = flat[first[rows][:, None] + np.arange(d)]
                good = np.isfinite(c).all(axis=1)
                with np.errstate(over="ignore"):
                    y = np.clip(np.floor(scale * c[good]), -2.0 ** 52, 2.0 ** 52)
                if good.any():
                    yield (b.column(0).take(pa.array(rows[good])) if b.num_columns > 1 else None), y.astype(np.int64) + offset


def _merged(partials: DataFrame, dtype) -> dict[int, tuple[int, np.ndarray]]:
    """Sum of the partials (task, dims, n, body) by dims; sums meet in MERGE streams first."""
    def run(batches):
        total: dict[int, list] = {}
        for b in batches:
            for d, n, body in zip(*(b.column(c).to_pylist() for c in ("dims", "n", "body"))):
                have = total.setdefault(d, [0, 0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(body, dtype)
        for d, (n, body) in total.items():
            yield pa.RecordBatch.from_pydict({"dims": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "body": pa.array([body.tobytes()], pa.binary())})
    rows = (partials.repartition(MERGE, F.pmod("task", F.lit(MERGE))).sortWithinPartitions("task", "dims")
            .select("dims", "n", "body").mapInArrow(run, "dims int, n long, body binary").collect())
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r.dims, r.n, bytes(r.body))):
        n, body = out.get(r.dims, (0, 0))
        out[r.dims] = n + r.n, body + np.frombuffer(r.body, dtype)
    return out


def _partials(vectors: DataFrame, scale, offset, summary) -> DataFrame:
    """One packed partial a task and length: the sum of ``summary(x)`` over its vectors."""
    def run(batches):
        total: dict[int, list] = {}
        for _, x in _batches(batches, scale, offset):
            part = summary(x)
            if part is not None:
                have = total.setdefault(x.shape[1], [0, 0])
                have[0] += len(x)
                have[1] = have[1] + part
        task = TaskContext.get().partitionId()
        for d, (n, body) in total.items():
            yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int32()), "dims": pa.array([d], pa.int32()),
                                              "n": pa.array([n], pa.int64()), "body": pa.array([body.tobytes()], pa.binary())})
    return vectors.mapInArrow(run, "task int, dims int, n long, body binary")


def _exact_sums(x):
    return np.concatenate([(x >> _SPLIT).sum(axis=0), (x & ((1 << _SPLIT) - 1)).sum(axis=0)])


def _vectors(table, vec_col):
    return table.select(F.col(vec_col).cast("array<double>").alias("vec"))


def fit_whitening(table: DataFrame, vec_col: str = "embedding", k: int = 32, scale: float = 64.0, offset: int = 0) -> Whitening | None:
    """The whitening of all usable vectors; None if there is none."""
    vectors = _vectors(table, vec_col)
    sums = _merged(_partials(vectors, scale, offset, _exact_sums), np.int64)
    if not sums:
        return None
    d = max(sums, key=lambda d: (sums[d][0], d))
    n, parts = sums[d]
    total = tuple((int(h) << _SPLIT) + int(l) for h, l in zip(parts[:d], parts[d:]))
    flat = Whitening(n, total, np.eye(d), np.ones(d), np.ones(d), scale, offset)

    def scatter(x):
        if x.shape[1] == d:
            z = flat.centred(x)[1]
            return (z.T @ z).ravel()
    cov = _merged(_partials(vectors, scale, offset, scatter), np.float64)[d][1].reshape(d, d) / n
    cov = (cov + cov.T) / 2
    values, components = leading(cov, k)
    return Whitening(n, total, components, values, values / np.trace(cov), scale, offset)


def identity_error(table: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured
    on the vectors (their centre is zero by construction)."""
    d, k = model.components.shape

    def scatter(x):
        if x.shape[1] == d:
            w = model.whiten(model.centred(x)[1])
            return (w.T @ w).ravel()
    cov = _merged(_partials(_vectors(table, vec_col), model.scale, model.offset, scatter), np.float64)[d][1].reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(table: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding", error: float | None = None) -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation (exact; null past
    63 bits), whitened, explained, identity_error."""
    d, k = model.components.shape

    def run(batches):
        for ids, x in _batches(batches, model.scale, model.offset):
            if x.shape[1] != d or not k:
                continue
            dev, z = model.centred(x)
            if dev.dtype != object and (z * model.n).__abs__().max(initial=0) ** 2 * d >= 2.0 ** 62:
                dev = dev.astype(object)
            square = (dev * dev).sum(axis=1)
            square = [v if v < 1 << 63 else None for v in square.tolist()]
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "id": ids.take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n, dtype=np.int64)), "deviation": pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array(model.whiten(z).ravel()), "explained": pa.array(np.tile(model.explained, m)),
                "identity_error": pa.array([error] * (m * k), pa.float64())})
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 32, scale: float = 64.0, offset: int = 0) -> DataFrame:
    """Fit on all usable vectors, measure, whiten."""
    model = fit_whitening(table, vec_col, k, scale, offset)
    if model is None or not len(model.values):
        d = len(model.sums) if model else 0
        model = Whitening(model.n if model else 0, model.sums if model else (), np.empty((d, 0)), np.empty(0), np.empty(0), scale, offset)
        return whiten(table, model, id_col, vec_col)
    return whiten(table, model, id_col, vec_col, identity_error(table, model, vec_col))
