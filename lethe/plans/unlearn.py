"""Unlearning updates as plans over DataFrames.

A plan reads the sample table, builds the change set with the rewrite
operators, runs one aggregate job per quantity (G, H or HVP), and does the
parameter-sized algebra on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sparse_dot
from ..operators import linear as lin
from ..operators import rewrite as rw
from ..operators import sampling as sa
from ..session import cut_lineage
from . import solvers


def first_order(theta: np.ndarray, G: np.ndarray, tau: float) -> np.ndarray:
    """Theta - tau G."""
    return np.asarray(theta) - tau * np.asarray(G)


def inverse_hvp(samples: DataFrame, theta, v: np.ndarray, d: int, lam: float, solver: str = "direct",
                damping: float = 0.0, scale: float | None = None) -> solvers.Solution:
    """(H(samples, theta) + damping I)^-1 v by the named solver.

    ``direct`` takes the d x d Hessian in one job, ``lissa`` iterates on that Hessian;
    ``cg`` runs one HVP job a step and never forms it (for wide models).
    """
    if solver == "cg":
        with solvers.persisted(samples) as data:
            return solvers.conjugate_gradient(lambda u: lin.hvp_vector(data, list(theta), list(u), d, lam), v, damping)
    H = lin.hessian_matrix(samples, list(theta), d, lam)
    if solver == "lissa":
        # dimensions that no row has: H is lambda there, solved in closed form
        alone = np.count_nonzero(H, axis=1) == 1
        x = np.where(alone, v / (np.diag(H) + damping), 0.0)
        rest = np.flatnonzero(~alone)
        part = solvers.lissa(lambda u: H[np.ix_(rest, rest)] @ u, v[rest], scale, damping)
        x[rest] = part.x
        return solvers.Solution(x, part.iterations, part.residual, part.converged)
    if solver != "direct":
        raise ValueError(f"unknown solver {solver!r}")
    A = H + damping * np.eye(d)
    x = np.linalg.solve(A, v)
    return solvers.Solution(x, 1, float(np.linalg.norm(v - A @ x) / max(np.linalg.norm(v), 1e-300)), True)


def second_order(edited: DataFrame, theta: np.ndarray, G: np.ndarray, d: int, lam: float, solver: str = "direct",
                 damping: float = 0.0, scale: float | None = None) -> np.ndarray:
    """Theta - H(edited, theta)^-1 G; raises if the solver does not converge."""
    found = inverse_hvp(edited, theta, G, d, lam, solver, damping, scale)
    if not found.converged:
        raise solvers.NotConverged(f"{solver}: relative residual {found.residual:.3g} after {found.iterations} steps")
    return np.asarray(theta) - found.x


def change_gradient(delta: DataFrame, theta, d: int) -> np.ndarray:
    """U1 as a dense vector."""
    return lin.to_vector(lin.gradient_diff(delta, list(theta)), d, value="g")


# U8 -----------------------------------------------------------------------------
def approx_retraining(delta: DataFrame, edited: DataFrame, theta, d: int, lam: float, order: int = 1,
                      tau: float = 1e-3, solver: str = "direct", damping: float = 0.0, scale: float | None = None):
    """(theta', G).  Dispatcher: order 1 -> U2; order 2 -> U3 with the named solver.  G = 0 -> no solve job."""
    theta = np.asarray(theta, dtype=float)
    G = change_gradient(delta, theta, d)
    if not np.any(G):
        return theta, G
    if order == 1:
        return first_order(theta, G, tau), G
    return second_order(edited, theta, G, d, lam, solver, damping, scale), G


# U5 -----------------------------------------------------------------------------
def influence_methods(train: DataFrame, edited: DataFrame, delta: DataFrame, theta, d: int, lam: float,
                      methods=("influence", "newton", "lazy"), inverse: dict | None = None) -> dict:
    """'influence' (H on original data), 'newton' (H on edited data), 'lazy' (unchanged).

    ``delta`` may change features or labels (``rw.removal_delta``, ``rw.flip_delta``).  ``inverse``
    keeps H^-1 by method: one that is there is used, one that is not is computed and put there.
    """
    theta = np.asarray(theta, dtype=float)
    G = change_gradient(delta, theta, d)
    inverse = {} if inverse is None else inverse
    out = {}
    for m in methods:
        if m == "lazy":
            out[m] = theta
            continue
        if m not in inverse:
            inverse[m] = np.linalg.inv(lin.hessian_matrix(edited if m == "newton" else train, list(theta), d, lam))
        out[m] = theta - inverse[m] @ G
    return out


# U4 -----------------------------------------------------------------------------
def stepwise_removal(train: DataFrame, dims: list[int], stepsize: int, theta, d: int, lam: float,
                     order: int = 2, tau: float = 1e-3) -> list[np.ndarray]:
    """Remove feature blocks of ``stepsize``; theta and the edited data are carried between steps.

    The edited table is checkpointed into the shared checkpoint folder after each
    step so the lineage does not grow with the number of steps.
    """
    cur = train
    th = np.asarray(theta, dtype=float)
    out = []
    for i in range(0, len(dims), stepsize):
        block = dims[i:i + stepsize]
        delta = rw.removal_delta(cur, block)
        G = change_gradient(delta, th, d)
        edited = cut_lineage(rw.remove_features(cur, block))
        th = first_order(th, G, tau) if order == 1 else second_order(edited, th, G, d, lam)
        out.append(th.copy())
        cur = edited
    return out


def stepwise_replacement(train: DataFrame, dims: list[int], n: int, rounds: int, theta, d: int, lam: float, seed,
                         order: int = 2, tau: float = 1e-3, key: str = "row_id") -> list[np.ndarray]:
    """``rounds`` rounds that each draw new values of ``dims`` for n // rounds seeded rows and update
    theta; theta and the edited data (checkpointed) carry over."""
    cur, th, out = train, np.asarray(theta, dtype=float), []
    for r in range(rounds):
        edited = cut_lineage(rw.draw_values(cur, dims, n // rounds, f"{seed}:{r}", key))
        chosen = sa.choose_rows(cur.select(key), key, n // rounds, f"{seed}:{r}")
        delta = rw.tuples_delta(rw.gather(cur, chosen, key).select(key, "y", "idx", "val"), edited.select(key, "y", "idx", "val"), key)
        G = change_gradient(delta, th, d)
        th = first_order(th, G, tau) if order == 1 else second_order(edited, th, G, d, lam)
        out.append(th.copy())
        cur = edited
    return out


# M8 -----------------------------------------------------------------------------
def fine_tune(rows: DataFrame, theta, d: int, lam: float, lr: float, n_batches: int,
              key: str = "row_id", seed=0) -> np.ndarray:
    """One mini-batch pass: rows fall into ``n_batches`` by seeded hash of the key, in order
    theta -= lr / rows * (gradient of the batch's loss + lambda theta).

    Sequential by definition: one job per batch, each over the persisted rows of all batches;
    the number of batches is the caller's, so it does not grow with the rows.
    """
    th = np.asarray(theta, dtype=float)
    with solvers.persisted(sa.assign_shards(rows, key, n_batches, seed)) as b:
        sizes = {r["shard"]: r["count"] for r in b.groupBy("shard").count().collect()}
        for i in sorted(sizes):
            g = lin.gradient_vector(b.where(F.col("shard") == i), list(th), d, lam)
            th = th - lr / sizes[i] * g
    return th


# U10 ----------------------------------------------------------------------------
def sharded_fit(samples: DataFrame, n_shards: int, d: int, lam: float, seed=0, key: str = "row_id") -> dict:
    """SISA: one model per shard, all shards fitted in the same Newton jobs."""
    s = sa.assign_shards(samples, key, n_shards, seed)
    return solvers.fit_newton(s, d, lam, key="shard", groups=range(n_shards))


def sharded_unlearn(samples: DataFrame, deleted: DataFrame, models: dict, n_shards: int, d: int, lam: float,
                    seed=0, key: str = "row_id") -> tuple[dict, list[int]]:
    """Retrain only the shards that contain deleted rows (J3), on their remaining rows."""
    s = sa.assign_shards(samples, key, n_shards, seed)
    hit = sorted(r["shard"] for r in s.join(deleted.select(key), key, "left_semi").select("shard").distinct().collect())
    if not hit:
        return dict(models), []
    rest = rw.exclude(s.where(F.col("shard").isin(hit)), deleted, key)
    new = solvers.fit_newton(rest, d, lam, key="shard", groups=hit)
    out = dict(models)
    out.update(new)
    return out, hit


def ensemble_predict(samples: DataFrame, models: dict, key: str = "row_id", keep: tuple = ()) -> DataFrame:
    """(key, vote) and the columns ``keep``: majority vote of the shard models (a shard without rows has none), scored
    in one pass; a tie votes -1."""
    votes = sum((F.when(sparse_dot("idx", "val", list(th)) >= 0, 1).otherwise(-1) for _, th in sorted(models.items())), F.lit(0))
    return samples.select(key, *keep, F.when(votes > 0, 1.0).otherwise(-1.0).alias("vote"))


# C1-C4 ----------------------------------------------------------------------------
def certification(residual_norm: float, epsilon: float, delta: float, sigma: float) -> dict:
    """c = sqrt(2 ln(1.5/delta)), beta = sigma eps / c, certified sigma = residual c / eps."""
    c = math.sqrt(2 * math.log(1.5 / delta))
    beta = sigma * epsilon / c
    return {"c": c, "beta": beta, "certified_sigma": residual_norm * c / epsilon,
            "certified": residual_norm <= beta}


def recovery(before: float, after: float, clean: float) -> float:
    """(after - before) / (clean - before)."""
    return (after - before) / (clean - before) if clean != before else float("nan")
