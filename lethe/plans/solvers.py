"""Driver-side iterative solvers whose every step is one distributed aggregate.

Only parameter-sized values (theta, gradient, d x d Hessian for the dense solvers)
return to the driver.  The sample table is persisted once (MEMORY_AND_DISK; a
lost executor recomputes its partitions from the parquet lineage) and released
at the end.

Every solver stops on a relative residual.  The linear ones return a ``Solution`` with
the residual and whether it met the tolerance; the fits raise ``NotConverged`` instead of
returning a model that did not.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import block_sums, columns_of, is_packed, packed, row_chunks


class NotConverged(ArithmeticError):
    """A fit ran out of steps before its gradient was small enough."""


@dataclass
class Solution:
    x: np.ndarray
    iterations: int
    residual: float                # |v - A x| / |v|
    converged: bool


@contextmanager
def persisted(df: DataFrame):
    """The table kept on the executors while a loop reads it; one that is kept already stays so."""
    if df.storageLevel != StorageLevel.NONE:
        yield df
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_newton(samples: DataFrame, d: int, lam: float, b=None, theta0=None, max_iter: int = 200,
               tol: float = 1e-8, key: str | None = None, groups=None) -> dict:
    """Minimise l + lambda/2 |theta|^2 + b . theta by damped Newton steps (one job per step for
    all groups; a step that raises the objective is halved).

    With ``key`` every group (shard) gets its own model, fitted in the same jobs; a group
    without rows gets no model.  Stops when |gradient| <= tol * (1 + |first gradient|).
    Returns {group: theta}.
    """
    from .grid import fit_grid, grid
    start = np.zeros(d) if theta0 is None else np.asarray(theta0, dtype=float)
    names = list(groups) if key else [None]
    rows = samples if is_packed(samples) else samples.select("y", "idx", "val", *([F.col(key).alias("shard")] if key else []))
    models = grid(np.repeat(start[None], len(names), axis=0), shard=names if key else None)
    found = fit_grid(rows, models, lam, 0.0 if b is None else b, max_iter, tol)
    return {g: t for g, t in zip(names, found) if not np.isnan(t).any()}


def _gradient_partials(theta: np.ndarray):
    """Per-task loss and gradient sums of sparse rows, the loss first."""
    d = len(theta)

    def run(batches):
        out = np.zeros(d + 1)
        for b, x in row_chunks(batches, 1):
            y, x = b.column("y").to_numpy(zero_copy_only=False).astype(float), x.small(d)
            m = y * x.dot(theta[:, None])[:, 0]
            e = np.exp(-np.abs(m))
            out[0] += (np.log1p(e) + np.maximum(-m, 0.0)).sum()
            out[1:] += x.tdot((-y * np.where(m >= 0, e, 1.0) / (1.0 + e))[:, None], d)[:, 0]
        return {0: out}
    return run


def loss_gradient(samples: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Sample loss and its gradient in one job."""
    theta = np.asarray(theta, dtype=float)
    out = block_sums(columns_of(samples, "y", "idx", "val"), _gradient_partials(theta)).get(0, np.zeros(len(theta) + 1))
    return float(out[0]), out[1:]


def fit_lbfgs(samples: DataFrame, d: int, lam: float, b=None, theta0=None, max_iter: int = 1000,
              m: int = 10, tol: float = 1e-8) -> np.ndarray:
    """L-BFGS, one loss+gradient job per evaluation (for wide models).

    Pairs without positive curvature are left out of the update.  Stops like ``fit_newton``.
    """
    bb = np.zeros(d) if b is None else np.asarray(b, dtype=float)
    with persisted(packed(samples, "y", "idx", "val")) as data:
        def fg(t):
            loss, g = loss_gradient(data, t)
            return loss + 0.5 * lam * t @ t + bb @ t, g + lam * t + bb

        x = np.zeros(d) if theta0 is None else np.asarray(theta0, dtype=float).copy()
        f, g = fg(x)
        goal = tol * (1 + np.linalg.norm(g))
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(max_iter):
            if np.linalg.norm(g) <= goal:
                return x
            q, alphas = g.copy(), []
            for s, y in reversed(pairs):
                alphas.append((s @ q) / (y @ s))
                q -= alphas[-1] * y
            q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(g), 1.0)
            for (s, y), alpha in zip(pairs, reversed(alphas)):
                q += s * (alpha - (y @ q) / (y @ s))
            step = 1.0
            while True:
                xn = x - step * q
                fn, gn = fg(xn)
                if fn <= f - 1e-4 * step * (g @ q) + 1e-12 * abs(f):
                    break
                step *= 0.5
                if step < 1e-12:
                    raise NotConverged("L-BFGS: no descent along the search direction")
            s, y = xn - x, gn - g
            if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                pairs = [*pairs, (s, y)][-m:]
            x, f, g = xn, fn, gn
    raise NotConverged(f"L-BFGS: gradient {np.linalg.norm(g):.3g} after {max_iter} steps")


# U6 -----------------------------------------------------------------------------
def lissa(hvp, v: np.ndarray, scale: float | None = None, damping: float = 0.0, max_iter: int = 100_000,
          patience: int = 1000, tol: float = 1e-10) -> Solution:
    """Deterministic LiSSA: x <- x + (v - (H + damping I) x) / scale, solving (H + damping I) x = v.

    ``scale`` defaults to the largest eigenvalue (Lanczos), with which the iteration
    contracts.  Unconverged when the residual has not improved for ``patience`` steps, is no
    longer finite, or after ``max_iter`` steps.
    """
    size = float(np.linalg.norm(v))
    if size == 0:
        return Solution(np.zeros_like(v), 0, 0.0, True)
    if scale is None:
        scale = 1.01 * (lanczos(hvp, len(v)).x[0] + damping)
    x, best, since = v / scale, np.inf, 0
    for it in range(1, max_iter + 1):
        r = v - hvp(x) - damping * x
        res = float(np.linalg.norm(r)) / size
        if res <= tol:
            return Solution(x, it, res, True)
        since = 0 if res < best else since + 1
        if not np.isfinite(res) or since > patience:
            return Solution(x, it, res, False)
        best = min(best, res)
        x = x + r / scale
    return Solution(x, max_iter, res, False)


# U7 -----------------------------------------------------------------------------
def conjugate_gradient(hvp, v: np.ndarray, damping: float = 0.0, max_iter: int | None = None, tol: float = 1e-10) -> Solution:
    """Solve (H + damping I) x = v with one HVP job per iteration (10 d + 50 at most by default)."""
    size = float(np.linalg.norm(v))
    x, r = np.zeros_like(v), v.copy()
    if size == 0:
        return Solution(x, 0, 0.0, True)
    p, rs = r.copy(), r @ r
    for it in range(1, (max_iter or 10 * len(v) + 50) + 1):
        Ap = hvp(p) + damping * p
        a = rs / (p @ Ap)
        x = x + a * p
        r = r - a * Ap
        new = r @ r
        if np.sqrt(new) <= tol * size:
            return Solution(x, it, float(np.sqrt(new)) / size, True)
        p, rs = r + (new / rs) * p, new
    return Solution(x, it, float(np.sqrt(rs)) / size, False)


# M11 ----------------------------------------------------------------------------
def lanczos(hvp, d: int, tol: float = 1e-9, max_iter: int | None = None, seed: int = 0) -> Solution:
    """(largest, smallest) eigenvalue of a symmetric H from HVP jobs, as ``x``.

    Lanczos with full reorthogonalisation; stops when the residual bounds of both Ritz
    values are below ``tol`` of the largest, or the Krylov space is exhausted (d steps).
    """
    rng = np.random.default_rng(seed)
    q = rng.standard_normal(d)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for it in range(1, min(d, max_iter or d) + 1):
        w = hvp(basis[-1])
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            for u in basis:
                w = w - (w @ u) * u
        size = float(np.linalg.norm(w))
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        top = max(abs(values[-1]), 1e-300)
        res = size * max(abs(vectors[-1, 0]), abs(vectors[-1, -1])) / top
        if res <= tol or it == d:
            break
        if size <= 1e-12 * top:                # invariant subspace: go on in its complement
            w = rng.standard_normal(d)
            for _ in range(2):
                for u in basis:
                    w = w - (w @ u) * u
            beta.append(0.0)
            basis.append(w / np.linalg.norm(w))
            continue
        beta.append(size)
        basis.append(w / size)
    return Solution(np.array([values[-1], values[0]]), it, float(res if it < d else 0.0), bool(res <= tol or it == d))
