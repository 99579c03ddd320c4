"""Second-order work on the softmax head: products, solves, fine-tuning, unlearning.

W is (classes, features) on the driver.  Its Hessian, (classes * features) squared, is never
formed: every solver step is one job that sends a block of W's size a task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import phash, uniform
from ..operators import softmax as sm
from ..operators.blocks import block_sums
from ..operators.prefix import global_rank
from ..operators.sampling import hash_cut
from .solvers import NotConverged, Solution, conjugate_gradient, persisted


def _features(batch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def head_hvp(rows: DataFrame, W: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Sum over the rows of x (p * z - p (p . z)), z = V x: the Hessian of the summed loss times V."""
    W, V = np.asarray(W, float), np.asarray(V, float)

    def partial(batches):
        out = np.zeros(W.shape)
        for b in batches:
            if b.num_rows:
                x = _features(b)
                p = _softmax(x @ W.T)
                u = p * (x @ V.T)
                out += (u - p * u.sum(axis=1, keepdims=True)).T @ x
        return {0: out.ravel()}
    return block_sums(rows.select("x"), partial).get(0, np.zeros(W.size)).reshape(W.shape)


def head_gradient(rows: DataFrame, W: np.ndarray) -> tuple[int, np.ndarray]:
    """(rows, sum of (p - onehot(label)) x)."""
    W = np.asarray(W, float)

    def partial(batches):
        out = np.zeros(W.size + 1)
        for b in batches:
            if b.num_rows:
                x = _features(b)
                p = _softmax(x @ W.T)
                p[np.arange(len(p)), b.column("label").to_numpy(zero_copy_only=False).astype(int)] -= 1
                out[:-1] += (p.T @ x).ravel()
                out[-1] += len(p)
        return {0: out}
    out = block_sums(rows.select("label", "x"), partial).get(0, np.zeros(W.size + 1))
    return int(out[-1]), out[:-1].reshape(W.shape)


# U7 on the head -------------------------------------------------------------------
def head_solve(rows: DataFrame, W: np.ndarray, G: np.ndarray, damping: float, tol: float = 1e-10) -> Solution:
    """(H + damping I)^-1 G by conjugate gradients, H the Hessian of the summed loss at W."""
    shape = np.shape(W)
    found = conjugate_gradient(lambda v: head_hvp(rows, W, v.reshape(shape)).ravel(), np.asarray(G, float).ravel(), damping, tol=tol)
    return Solution(found.x.reshape(shape), found.iterations, found.residual, found.converged)


# U6 -------------------------------------------------------------------------------
@dataclass(frozen=True)
class Estimate:
    """A stochastic inverse product: the mean of the rounds, whether it diverged, and per round
    the sizes of its steps (sum of absolute changes)."""
    x: np.ndarray
    diverged: bool
    steps: list[list[float]]


def lissa_rounds(hvp: Callable[[int, int, np.ndarray], np.ndarray], v: np.ndarray, batches: int, scale: float, damping: float,
                 iterations: int | None = None, rounds: int = 1, patience: int = 20) -> Estimate:
    """u <- v + (1 - damping) u - H_batch u / scale from u = v, one batch's product a step; the result
    is u / scale, averaged over ``rounds``.

    ``hvp(round, batch, u)`` gives the product with the Hessian as the batch estimates it; batches
    come in turn, ``iterations`` steps a round (one pass by default).  In the mean this
    solves (H + damping * scale I) x = v.  A round stops when a step is larger than the
    smallest so far after ``patience`` steps without a smaller one; if that happens in the first
    ``patience`` steps, or the estimate is not finite, the whole estimate has diverged.
    """
    v = np.asarray(v, float)
    total, log = np.zeros_like(v), []
    for r in range(rounds):
        u, least, since, sizes = v, np.inf, -1, []
        log.append(sizes)
        for i in range(batches if iterations is None else iterations):
            new = v + (1 - damping) * u - hvp(r, i % batches, u) / scale
            size = float(np.abs(new - u).sum())
            sizes.append(size)
            stop = size > least and since >= patience
            if size < least:
                least, since = size, 1
            since += 1
            u = new
            if not np.isfinite(size) or (stop and i < patience):
                return Estimate(u / scale, True, log)
            if stop:
                break
        total += u / scale / rounds
    return Estimate(total, False, log)


def dealt(rows: DataFrame, batches: int, rounds: int, seed, key: str = "row_id") -> DataFrame:
    """The rows with ``deal``: for every round the batch that a seeded hash of the key deals them to."""
    deal = [F.pmod(phash(key, f"{seed}:{r}"), F.lit(batches)).cast("int") for r in range(rounds)]
    return rows.withColumn("deal", F.array(*deal))


def batch_products(rows: DataFrame, batches: int, hvp: Callable[[DataFrame, np.ndarray], np.ndarray]):
    """``hvp(round, batch, u)`` for ``lissa_rounds`` over rows with ``deal``: the batch's summed product
    times rows / rows of the batch, an estimate of the sum over all rows.  An empty batch
    gives zero."""
    counts = {(r["r"], r["b"]): r["n"] for r in rows.select(F.posexplode("deal").alias("r", "b")).groupBy("r", "b").agg(F.count("*").alias("n")).collect()}
    n = sum(c for (r, _), c in counts.items() if r == 0)

    def product(r, b, u):
        if (r, b) not in counts:
            return np.zeros_like(u)
        return hvp(rows.where(F.element_at("deal", r + 1) == b), u) * (n / counts[r, b])
    return product


def head_lissa(rows: DataFrame, W: np.ndarray, G: np.ndarray, batches: int, scale: float, damping: float, iterations: int | None = None,
               rounds: int = 1, patience: int = 20, seed=0) -> Estimate:
    """Stochastic (H + damping * scale I)^-1 G: each step is one job over one batch of the rows."""
    with persisted(dealt(rows, batches, rounds, seed).select("x", "deal")) as data:
        return lissa_rounds(batch_products(data, batches, lambda part, u: head_hvp(part, W, u)), G, batches, scale, damping, iterations, rounds, patience)


# U8 -------------------------------------------------------------------------------
@dataclass(frozen=True)
class Second:
    """How a second-order step is solved: ``cg`` (damping as given) or ``lissa`` (damping * scale)."""
    damping: float
    solver: str = "cg"
    scale: float = 1.0
    batches: int = 1
    iterations: int | None = None
    rounds: int = 1
    patience: int = 20
    seed: int = 0


def update(rows: DataFrame, W: np.ndarray, G: np.ndarray, tau: float, second: Second | None = None) -> tuple[np.ndarray, bool]:
    """(new W, diverged): W - tau G, or W - H^-1 G over ``rows`` with ``second``.  G = 0 needs no job; a
    solve that diverges leaves W."""
    if not np.any(G):
        return W, False
    if second is None:
        return W - tau * G, False
    if second.solver == "cg":
        found = head_solve(rows, W, G, second.damping)
        if not found.converged:
            raise NotConverged(f"CG: relative residual {found.residual:.3g} after {found.iterations} steps")
        return W - found.x, False
    if second.solver != "lissa":
        raise ValueError(f"unknown solver {second.solver!r}")
    found = head_lissa(rows, W, G, second.batches, second.scale, second.damping, second.iterations, second.rounds, second.patience, second.seed)
    return (W, True) if found.diverged else (W - found.x, False)


# R8 -------------------------------------------------------------------------------
def draw_rows(rows: DataFrame, n: int, seed, key: str = "row_id") -> DataFrame:
    """n draws with replacement: the rows of ``rows`` (unique ``key``) with ``draw`` 0..n-1; a row
    comes as often as it is drawn.  Ranks come from a global order, draws from a seeded hash of
    their number; the two meet in a join on the rank."""
    ranked = global_rank(rows, [F.col(key)], name="__rank")
    total = rows.count()
    draws = rows.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), (F.floor(uniform("id", seed) * total) + 1).cast("long").alias("__rank"))
    return draws.join(ranked, "__rank").drop("__rank")


# U9 / U12 ---------------------------------------------------------------------------
def unlearn_steps(train: DataFrame, valid: DataFrame, W: np.ndarray, steps: int, seed, tau: float = 0.0, second: Second | None = None,
                  batch: int | None = None, ratio: float | None = None) -> tuple[np.ndarray, list[dict]]:
    """Iterative unlearning of wrong labels, order 1 or (with ``second``) order 2.

    ``train`` has row_id, the corrected ``label``, x, and ``old_label``: the wrong label of a row of
    the change set, null elsewhere.  Each step predicts all rows and takes as change set

    * with ``batch``: the first ``batch`` wrongly predicted rows by seeded hash, moved from the
      prediction to the corrected label;
    * with ``ratio``: the change set itself, moved from the old label, and ratio * its size
      draws with replacement from the wrong rows outside it, moved from the prediction.

    The Hessian is taken over all train rows.  Logs: valid accuracy after the step, rows wrong
    (delta_size), outside the change set (new_errors) and in it (remaining).  Stops when
    nothing is wrong or a solve diverges, whose step is not taken.
    """
    if (batch is None) == (ratio is None):
        raise ValueError("give one of batch and ratio")
    W = np.asarray(W, float)
    K, d = W.shape
    log: list[dict] = []
    wrong, flipped = F.col("pred") != F.col("label"), F.col("old_label").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    with persisted(train.select("row_id", "label", "old_label", "x")) as rows, persisted(valid.select("label", "x")) as held:
        for step in range(steps):
            seen = sm.predict(rows, W)
            if batch is not None:
                delta = hash_cut(seen.where(wrong), "row_id", f"{seed}:{step}", batch).select(F.col("pred").alias("old_label"), F.col("label").alias("new_label"), "x")
            else:
                own = rows.where(flipped).select(F.col("old_label").cast("int").alias("old_label"), F.col("label").alias("new_label"), "x")
                drawn = draw_rows(seen.where(wrong & ~flipped).select("row_id", "label", "pred", "x"), int(ratio * own.count()), f"{seed}:{step}")
                delta = own.unionByName(drawn.select(F.col("pred").alias("old_label"), F.col("label").alias("new_label"), "x"))
            G = sm.as_matrix(sm.label_change_gradient(delta, K, d), K, d)
            if not G.any():
                break
            W, diverged = update(rows, W, G, tau, second)
            r = sm.predict(rows, W).agg(count(wrong).alias("size"), count(wrong & ~flipped).alias("new"), count(wrong & flipped).alias("left")).first()
            right = sm.predict(held, W).agg(F.avg((~wrong).cast("int"))).first()[0]
            log.append({"step": step, "valid_accuracy": float(right or 0.0), "delta_size": r["size"], "new_errors": r["new"], "remaining": r["left"],
                        "diverged": diverged})
            if diverged or not r["size"]:
                break
    return W, log


# M9 -------------------------------------------------------------------------------
def sgd(rows: DataFrame, W: np.ndarray, lr: float, batches: int, epochs: int, seed, key: str = "row_id") -> np.ndarray:
    """Mini-batch fine-tuning: every epoch deals the rows anew into ``batches`` by seeded hash and
    steps W -= lr * mean gradient through them, one job a batch; an empty batch makes no step."""
    W = np.asarray(W, float)
    with persisted(dealt(rows, batches, epochs, seed, key).select("label", "x", "deal")) as data:
        for epoch in range(epochs):
            for b in range(batches):
                n, grad = head_gradient(data.where(F.element_at("deal", epoch + 1) == b), W)
                W = W - lr / max(n, 1) * grad
    return W


# Q8 -------------------------------------------------------------------------------
def cell_gradients(rows: DataFrame, Ws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, right, gradient) per cell: cell c has the model Ws[c] and the labels ``labels[c]`` of the
    rows (labels array<int>, x).  One job for all cells."""
    cells, K, d = Ws.shape

    def partial(batches):
        out = np.zeros((cells, K * d + 2))
        for b in batches:
            if not b.num_rows:
                continue
            x = _features(b)
            labels = b.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(len(x), cells)
            for c in range(cells):
                p = _softmax(x @ Ws[c].T)
                out[c, -1] += (p.argmax(axis=1) == labels[:, c]).sum()
                out[c, -2] += len(x)
                p[np.arange(len(x)), labels[:, c]] -= 1
                out[c, :-2] += (p.T @ x).ravel()
        return dict(enumerate(out))
    sums = block_sums(rows.select("labels", "x"), partial)
    out = np.stack([sums[c] for c in range(cells)]) if sums else np.zeros((cells, K * d + 2))
    return out[:, -2].astype(int), out[:, -1].astype(int), out[:, :-2].reshape(cells, K, d)


def poison_grid(train: DataFrame, valid: DataFrame, flips: DataFrame, cells: int, K: int, d: int, lr: float, epochs: int, tau: float) -> list[tuple[int, str, float, float, float]]:
    """(cell, method, before, after, restored) for a grid of label flips over the same rows.

    ``flips`` has cell, row_id, new_label.  In every cell a head is trained on the flipped labels;
    ``first-order`` moves it by tau times the gradient difference of the flipped rows,
    ``fine-tuning`` by one epoch on the clean labels.  Accuracies are on ``valid``, restored is the
    share of what the flips cost against a head trained on clean labels.  The jobs do not
    depend on the number of cells.
    """
    picked = flips.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "new_label"))).alias("m"))
    labels = F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda c: F.coalesce(F.when(F.col("m").isNotNull(), F.try_element_at("m", c.cast("int"))), F.col("label")))
    rows = train.join(picked, "row_id", "left").select(labels.cast("array<int>").alias("labels"), "x")      # the last cell has no flips
    clean = lambda df: df.select(F.array_repeat("label", cells + 1).alias("labels"), "x")
    with persisted(rows) as data, persisted(clean(train)) as truth, persisted(clean(valid)) as held:
        W = np.zeros((cells + 1, K, d))
        for _ in range(epochs):
            n, _, grad = cell_gradients(data, W)
            W = W - lr * grad / np.maximum(n, 1)[:, None, None]
        accuracy = lambda V: (lambda n, right, _: right / np.maximum(n, 1))(*cell_gradients(held, V))
        n, _, right = cell_gradients(truth, W)
        wrong = cell_gradients(data, W)[2]
        repaired = {"first-order": W - tau * (right - wrong), "fine-tuning": W - lr * right / np.maximum(n, 1)[:, None, None]}
        before = accuracy(W)
        out = []
        for method, V in repaired.items():
            after = accuracy(V)
            for c in range(cells):
                lost = before[cells] - before[c]
                out.append((c, method, float(before[c]), float(after[c]), float((after[c] - before[c]) / lost) if lost else 0.0))
    return out
