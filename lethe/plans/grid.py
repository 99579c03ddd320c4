"""Many binary models over the same rows in the same jobs.

A grid is an axis of models beside the axis of rows: each model has its parameters, its
columns (the others count as removed from its rows), and optionally one shard of the rows
or only the rows that its removal leaves untouched.  A batch of rows meets all models in
one product, so the number of jobs of a plan does not depend on the number of models; the
sums of a model return as one packed block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import block_sums, columns_of, is_packed, packed, row_chunks
from ..operators.sampling import assign_shards
from .solvers import NotConverged, persisted


@dataclass(frozen=True)
class Grid:
    """``theta`` and ``keep`` are (models, d); ``shard`` is -1 for all rows; ``untouched`` leaves out
    the rows that have a removed column."""
    theta: np.ndarray
    keep: np.ndarray
    shard: np.ndarray
    untouched: np.ndarray

    def __len__(self):
        return len(self.theta)

    def take(self, which) -> Grid:
        return Grid(self.theta[which], self.keep[which], self.shard[which], self.untouched[which])


def grid(theta, keep=None, shard=None, untouched=False) -> Grid:
    theta = np.atleast_2d(np.asarray(theta, dtype=float))
    m = len(theta)
    return Grid(theta, np.ones(theta.shape, bool) if keep is None else np.asarray(keep, bool),
                np.full(m, -1) if shard is None else np.asarray(shard), np.full(m, untouched))


@dataclass(frozen=True)
class Stats:
    """Per model: rows, summed loss, rows of class +1, rows predicted +1, rows of both, gradient,
    Hessian or product (if asked)."""
    n: np.ndarray
    loss: np.ndarray
    positive: np.ndarray
    predicted: np.ndarray
    both: np.ndarray
    grad: np.ndarray
    hess: np.ndarray | None
    hv: np.ndarray | None

    @property
    def accuracy(self) -> np.ndarray:
        return (self.n - self.positive - self.predicted + 2 * self.both) / np.maximum(self.n, 1)

    def f1(self) -> tuple[np.ndarray, np.ndarray]:
        """(macro, weighted) mean of the two classes' F1; a class without rows or predictions has 0."""
        neither = self.n - self.positive - self.predicted + self.both
        up = 2 * self.both / np.maximum(self.positive + self.predicted, 1)
        down = 2 * neither / np.maximum(2 * self.n - self.positive - self.predicted, 1)
        return (up + down) / 2, (up * self.positive + down * (self.n - self.positive)) / np.maximum(self.n, 1)

    def __getitem__(self, part) -> Stats:
        return Stats(*(None if v is None else v[part] for v in vars(self).values()))


_HEAD = 5                      # sums before the gradient
PAIRS = 64                     # most products of two columns that a batch holds for its Hessians


def _factor(y, s):
    """-y sigma(-y s) without overflow."""
    m = y * s
    e = np.exp(-np.abs(m))
    return -y * np.where(m >= 0, e, 1.0) / (1.0 + e)


def _curvature(s):
    e = np.exp(-np.abs(s))
    return e / (1.0 + e) ** 2


def _log1p_sums(e: np.ndarray) -> np.ndarray:
    """Sums of ln(1 + e) over the rows, 0 <= e <= 1: two rows make one, (1 + a)(1 + b) - 1, up to
    512 rows before the logarithm is taken."""
    total = np.zeros(e.shape[1:])
    for _ in range(9):
        half = len(e) // 2
        if not half:
            break
        if len(e) % 2:
            total = total + np.log1p(e[-1])
        a, b = e[:half], e[half:2 * half]
        e = a * b
        e += a
        e += b
    return total + np.log1p(e).sum(axis=0)


def _columns(rows: DataFrame) -> list[str]:
    return ["y", "idx", "val", *(c for c in ("shard", "batch") if c in rows.columns)]


def grid_stats(rows: DataFrame, g: Grid, hessian: bool = False, vectors: np.ndarray | None = None, by: str = "shard") -> Stats:
    """One job: sums of every model over its rows.  ``vectors`` (models, d) asks for the
    Hessian-vector products, ``hessian`` for the d x d sums themselves; ``by`` names the column
    that a model's ``shard`` is a value of."""
    m, d = g.theta.shape
    weights = (g.theta * g.keep).T
    gone = (~g.keep).T.astype(float)
    parts = {s: np.flatnonzero(g.shard == s) for s in np.unique(g.shard).tolist()}
    i, j = np.triu_indices(d)
    size = _HEAD + d + (len(i) if hessian else 0) + (d if vectors is not None else 0)

    def meet(out, x, y, at):
        s = x.dot(weights[:, at])
        margin, positive = y * s, (y[:, 0] > 0).astype(float)
        all_rows = np.ones(x.n)
        e = np.abs(margin)
        np.exp(np.negative(e, out=e), out=e)
        predicted, both = np.stack([all_rows, positive]) @ (s >= 0).astype(float)
        for c, v in enumerate((x.n, _log1p_sums(e) + all_rows @ np.maximum(-margin, 0.0), positive.sum(), predicted, both)):
            out[at, c] += v
        less = 1.0 / (1.0 + e)
        more = e * less
        out[at, _HEAD:_HEAD + d] += x.tdot(-y * np.where(margin >= 0, more, less), d).T * g.keep[at]
        if hessian or vectors is not None:
            curve = more * less if (np.abs(y) == 1).all() else _curvature(s)
        if hessian:
            dense = x.dense(d)
            if len(i) <= PAIRS:
                across = np.ascontiguousarray(dense.T)
                pairs = across[i]
                pairs *= across[j]
                h = (pairs @ curve).T
            else:
                h = np.stack([((dense * curve[:, c:c + 1]).T @ dense)[i, j] for c in range(len(at))])
            out[at, _HEAD + d:_HEAD + d + len(i)] += h * (g.keep[at][:, i] & g.keep[at][:, j])
        if vectors is not None:
            out[at, -d:] += x.tdot(curve * x.dot((vectors * g.keep)[at].T), d).T * g.keep[at]

    def add(out, x, y, at):
        calm = g.untouched[at] & gone[:, at].any(axis=0)
        if not calm.all():
            meet(out, x, y, at[~calm])
        if calm.any():                         # a model meets only the rows that it keeps
            rest = ~x.has(gone[:, at[calm]])
            for c, k in enumerate(at[calm]):
                if rest[:, c].any():
                    meet(out, x.where(rest[:, c]), y[rest[:, c]], np.array([k]))

    def partial(batches):
        out = np.zeros((m, size))
        most = max(map(len, parts.values()))
        wide = max(most, len(i) if hessian and len(i) <= PAIRS else 1)
        for b, x in row_chunks(batches, most, dense=wide if -1 in parts else -(-wide // len(parts))):
            y, x = b.column("y").to_numpy(zero_copy_only=False)[:, None].astype(float), x.small(d)
            for s, at in parts.items():
                if s < 0:
                    add(out, x, y, at)
                else:                          # a row meets only the models of its shard
                    mine = b.column(by).to_numpy(zero_copy_only=False) == s
                    if mine.any():
                        add(out, x.where(mine), y[mine], at)
        return dict(enumerate(out))
    sums = block_sums(columns_of(rows, *_columns(rows)), partial)
    out = np.stack([sums[k] for k in range(m)]) if sums else np.zeros((m, size))
    hess = None
    if hessian:
        hess = np.zeros((m, d, d))
        hess[:, i, j] = hess[:, j, i] = out[:, _HEAD + d:_HEAD + d + len(i)]
    n, positive, predicted, both = (out[:, c].astype(int) for c in (0, 2, 3, 4))
    return Stats(n, out[:, 1], positive, predicted, both, out[:, _HEAD:_HEAD + d], hess, out[:, -d:] if vectors is not None else None)


def fit_grid(rows: DataFrame, g: Grid, lam, b=0.0, max_iter: int = 200, tol: float = 1e-11, evaluated: np.ndarray | None = None) -> np.ndarray:
    """Minimise l + lam/2 |theta|^2 + b . theta for every model by damped Newton steps, one job a
    step for all models that are not done.  ``lam`` is one value a model or for all, ``b`` a
    vector a model or for all.  A model without rows is NaN.  Stops like ``solvers.fit_newton``.
    ``evaluated`` (models) gets the rows whose gradient each model took, added up over its steps."""
    m, d = g.theta.shape
    lam, b = np.broadcast_to(np.asarray(lam, float), (m,)), np.broadcast_to(np.asarray(b, float), (m, d))
    at, move = g.theta.copy(), np.zeros((m, d))
    value, first = np.full(m, np.inf), np.full(m, np.nan)
    live, out = np.arange(m), np.full((m, d), np.nan)
    with persisted(packed(rows, *_columns(rows))) as data:
        for _ in range(max_iter):
            trial = at[live] + move[live]
            st = grid_stats(data, replace(g.take(live), theta=trial), hessian=True)
            if evaluated is not None:
                evaluated[live] += st.n
            done = []
            for k, i in enumerate(live):
                if not st.n[k]:
                    done.append(i)
                    continue
                f = st.loss[k] + 0.5 * lam[i] * trial[k] @ trial[k] + b[i] @ trial[k]
                if f > value[i] + 1e-9 * abs(value[i]):
                    move[i] /= 2
                    continue
                at[i], value[i] = trial[k], f
                slope = st.grad[k] + lam[i] * trial[k] + b[i]
                size = float(np.linalg.norm(slope))
                first[i] = size if np.isnan(first[i]) else first[i]
                if size <= tol * (1 + first[i]):
                    out[i] = trial[k]
                    done.append(i)
                    continue
                move[i] = -np.linalg.solve(st.hess[k] + lam[i] * np.eye(d), slope)
            live = np.setdiff1d(live, done)
            if not len(live):
                return out
    raise NotConverged(f"Newton: {len(live)} of {m} models after {max_iter} steps")


def change_gradients(rows: DataFrame, theta: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """(models, d): G of each model when the columns in ``before`` but not in ``after`` go: the sum
    over the rows that have one of them of the gradient at the edited less that at the old row."""
    m, d = theta.shape
    gone = (before & ~after).T.astype(float)

    def partial(batches):
        out = np.zeros((m, d))
        for b, x in row_chunks(batches, m):
            y, x = b.column("y").to_numpy(zero_copy_only=False)[:, None].astype(float), x.small(d)
            hit = x.has(gone)
            new, old = (x.tdot(hit * _factor(y, x.dot((theta * k).T)), d).T * k for k in (after, before))
            out += new - old
        return dict(enumerate(out))
    sums = block_sums(columns_of(rows, "y", "idx", "val"), partial)
    return np.stack([sums[k] for k in range(m)]) if sums else np.zeros((m, d))


def second_orders(rows: DataFrame, theta: np.ndarray, keep: np.ndarray, G: np.ndarray, lam: float) -> np.ndarray:
    """theta - H^-1 G of every model, H over its edited rows at its theta."""
    hess = grid_stats(rows, grid(theta, keep), hessian=True).hess
    return theta - np.stack([np.linalg.solve(h + lam * np.eye(len(h)), v) for h, v in zip(hess, G)])


def stepwise(rows: DataFrame, theta: np.ndarray, combos: list[list[int]], stepsize: int, lam: float, order: int, tau: float) -> np.ndarray:
    """All combinations at once, each losing ``stepsize`` more of its columns a step; parameters and
    edited rows carry over.  One or two jobs a step."""
    m, d = theta.shape
    before = np.ones((m, d), bool)
    for at in range(0, max(map(len, combos)), stepsize):
        after = before.copy()
        for k, c in enumerate(combos):
            after[k, c[at:at + stepsize]] = False
        G = change_gradients(rows, theta, before, after)
        theta = theta - tau * G if order == 1 else second_orders(rows, theta, after, G, lam)
        before = after
    return theta


def fine_tunes(rows: DataFrame, theta: np.ndarray, keep: np.ndarray, lam: float, lr: float, batches: int, b=0.0,
               key: str = "row_id", seed=0) -> np.ndarray:
    """One mini-batch pass of every model over its edited rows: one job a batch.  Batches are dealt
    by hash (packed rows bring theirs as ``batch``); theta -= lr / rows of the batch * (gradient + lam theta + b)."""
    dealt = rows if is_packed(rows) else assign_shards(rows.drop("shard"), key, batches, seed).withColumnRenamed("shard", "batch")
    with persisted(packed(dealt, "y", "idx", "val", "batch")) as data:
        for k in range(batches):
            st = grid_stats(data, grid(theta, keep, np.full(len(theta), k)), by="batch")
            if st.n[0]:
                theta = theta - lr / st.n[0] * (st.grad + lam * theta + b)
    return theta


def vote_right(rows: DataFrame, theta: np.ndarray, keep: np.ndarray) -> tuple[int, np.ndarray]:
    """(rows, rows that the vote gets right) per ensemble; ``theta`` is (ensembles, shards, d), NaN
    where a shard has no model; a tie votes -1."""
    e, shards, d = theta.shape
    has = ~np.isnan(theta[:, :, 0])
    weights = (np.nan_to_num(theta) * keep[:, None, :]).reshape(e * shards, d).T

    def partial(batches):
        out = np.zeros(e + 1)
        for b, x in row_chunks(batches, e * shards):
            y, x = b.column("y").to_numpy(zero_copy_only=False)[:, None].astype(float), x.small(d)
            sign = np.where(x.dot(weights).reshape(x.n, e, shards) >= 0, 1, -1) * has
            out[:e] += (np.where(sign.sum(axis=2) > 0, 1.0, -1.0) == y).sum(axis=0)
            out[e] += x.n
        return {0: out}
    out = block_sums(columns_of(rows, "y", "idx", "val"), partial).get(0, np.zeros(e + 1))
    return int(out[e]), out[:e].astype(int)


METHODS = ("DP", "Occlusion", "1st-Order", "2nd-Order", "Retrained", "Sharding", "Finetuning", "1st-Order-It", "2nd-Order-It")


@dataclass(frozen=True)
class Removal:
    """Parameters of an unlearning comparison."""
    lam: float
    tau: float                 # rate of the first-order updates
    lr: float                  # rate of fine-tuning
    batches: int
    stepsize: int
    shards: int
    shard_seed: int = 0
    batch_seed: int = 0


def dealt_rows(train: DataFrame, how: Removal) -> DataFrame:
    """Packed rows with the shard and batch of each; packed ones bring theirs."""
    if is_packed(train):
        return train
    batches = assign_shards(train.drop("shard"), "row_id", how.batches, how.batch_seed).withColumnRenamed("shard", "batch")
    return packed(assign_shards(batches, "row_id", how.shards, how.shard_seed), "y", "idx", "val", "shard", "batch")


def unlearned(train: DataFrame, combos: list[list[int]], d: int, how: Removal, b=0.0, methods=METHODS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(keep, {method: theta}) for every combination of removed columns: theta is (combinations, d),
    for ``Sharding`` (combinations, shards, d).  ``train`` has a key ``row_id``, or is packed with
    the ``shard`` and ``batch`` of its rows."""
    m = len(combos)
    keep = np.ones((m, d), bool)
    for k, c in enumerate(combos):
        keep[k, c] = False
    out: dict[str, np.ndarray] = {}
    with persisted(dealt_rows(train, how)) as rows:
        start = np.repeat(fit_grid(rows, grid(np.zeros(d)), how.lam, b), m, axis=0)
        G = change_gradients(rows, start, np.ones_like(keep), keep)
        out["DP"] = out["Occlusion"] = start
        out["1st-Order"] = start - how.tau * G
        if "2nd-Order" in methods:
            out["2nd-Order"] = second_orders(rows, start, keep, G, how.lam)
        if "Retrained" in methods:
            out["Retrained"] = fit_grid(rows, grid(np.zeros((m, d)), keep), how.lam, b)
        if "Sharding" in methods:
            # a shard that a removal does not touch keeps all its rows, hence its model
            each = grid(np.zeros((m * how.shards, d)), np.repeat(keep, how.shards, axis=0), np.tile(np.arange(how.shards), m), True)
            # the kept rows have none of the removed columns, so their models need no mask
            out["Sharding"] = fit_grid(rows, each, how.lam, b).reshape(m, how.shards, d)
        if "Finetuning" in methods:
            out["Finetuning"] = fine_tunes(rows, start, keep, how.lam, how.lr, how.batches, b, seed=how.batch_seed)
        if "1st-Order-It" in methods:
            out["1st-Order-It"] = stepwise(rows, start, combos, how.stepsize, how.lam, 1, how.tau)
        if "2nd-Order-It" in methods:
            out["2nd-Order-It"] = stepwise(rows, start, combos, how.stepsize, how.lam, 2, how.tau)
    return keep, {k: out[k] for k in methods}


def scores(test: DataFrame, keep: np.ndarray, thetas: dict[str, np.ndarray]) -> dict[str, Stats]:
    """Sums of every method and combination over the edited rows, in one job; not for ``Sharding``."""
    names = [k for k, t in thetas.items() if t.ndim == 2]
    m = len(keep)
    st = grid_stats(test, grid(np.concatenate([thetas[k] for k in names]), np.tile(keep, (len(names), 1))))
    return {name: st[k * m:(k + 1) * m] for k, name in enumerate(names)}


def accuracies(test: DataFrame, keep: np.ndarray, thetas: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Accuracy on the edited rows per method and combination (two jobs)."""
    with persisted(packed(test, "y", "idx", "val")) as rows:
        out = {k: s.accuracy for k, s in scores(rows, keep, thetas).items()}
        for k, t in thetas.items():
            if t.ndim == 3:
                n, right = vote_right(rows, t, keep)
                out[k] = right / max(n, 1)
    return out


def objectives(stats: Stats, theta: np.ndarray, lam: float, b=0.0) -> np.ndarray:
    """l + lam/2 |theta|^2 + b . theta per model."""
    return stats.loss + 0.5 * lam * (theta * theta).sum(axis=1) + (theta * b).sum(axis=1)


def residuals(rows: DataFrame, keep: np.ndarray, thetas: dict[str, np.ndarray], lam: float, b=0.0) -> dict[str, np.ndarray]:
    """Norm of the objective's gradient on the edited rows per method and combination (one job)."""
    return {k: np.linalg.norm(s.grad + lam * thetas[k] + b, axis=1) for k, s in scores(rows, keep, thetas).items()}


# U14 --------------------------------------------------------------------------------
def block_influence(rows: DataFrame, theta: np.ndarray, sample: tuple[float, np.ndarray], blocks: list[list[int]], lam: float) -> np.ndarray:
    """Influence of every feature block on the loss of one prediction, in two jobs whatever the
    number of blocks: sum over all rows of (gradient without the block - gradient) . s / n.

    s = H^-1 grad l(sample) is shared.  A gradient is f x, so a row and block need only the
    block's part of the row's score and of x . s; rows without the block add nothing.
    ``sample`` is (y, dense x).
    """
    theta = np.asarray(theta, float)
    d, m = len(theta), len(blocks)
    y0, x0 = sample
    st = grid_stats(rows, grid(theta), hessian=True)
    s = np.linalg.solve(st.hess[0] + lam * np.eye(d), _factor(np.array([y0]), np.array([x0 @ theta]))[0] * x0)
    member = np.zeros((d, m))
    for k, c in enumerate(blocks):
        member[c, k] = 1.0
    weights = np.column_stack([theta, s, member * theta[:, None], member * s[:, None]])

    def partial(batches):
        out = np.zeros(m)
        for b, x in row_chunks(batches, 2 * m + 2):
            y = b.column("y").to_numpy(zero_copy_only=False)[:, None].astype(float)
            z = x.dot(weights)
            hit = x.has(member)
            old = _factor(y, z[:, :1]) * z[:, 1:2]
            new = _factor(y, z[:, :1] - z[:, 2:2 + m]) * (z[:, 1:2] - z[:, 2 + m:])
            out += (hit * (new - old)).sum(axis=0)
        return {0: out}
    sums = block_sums(columns_of(rows, "y", "idx", "val"), partial)
    return sums.get(0, np.zeros(m)) / max(int(st.n[0]), 1)


# A17 --------------------------------------------------------------------------------
def performance(train: DataFrame, test: DataFrame, theta, lam: float, b=0.0) -> DataFrame:
    """One row: accuracy, macro and weighted F1, areas under the ROC and PR curve on ``test``, loss and
    squared gradient norm of the objective on both."""
    from ..operators.linear import predict
    from ..operators.metrics import roc_pr_auc
    theta = np.atleast_2d(np.asarray(theta, float))
    out = {}
    for name, rows in (("test", test), ("train", train)):
        st = grid_stats(rows, grid(theta))
        out[f"{name}_loss"] = float(objectives(st, theta, lam, b)[0])
        out[f"{name}_gradient_norm"] = float(((st.grad[0] + lam * theta[0] + b) ** 2).sum())
        if name == "test":
            out["accuracy"], (macro, weighted) = float(st.accuracy[0]), st.f1()
            out["macro_f1"], out["weighted_f1"] = float(macro[0]), float(weighted[0])
    areas = roc_pr_auc(predict(test, theta[0].tolist()), "p", "y", 1.0)
    return areas.select(*[F.lit(v).alias(k) for k, v in out.items()], "roc_auc", "pr_auc")


# Q6 / Q7 / A20 ------------------------------------------------------------------------
def touched_rows(rows: DataFrame, keep: np.ndarray) -> np.ndarray:
    """Rows that have a removed column, per model, in one job."""
    gone = (~keep).T.astype(float)

    def partial(batches):
        out = np.zeros(len(keep))
        for _, x in row_chunks(batches, len(keep)):
            out += x.has(gone).sum(axis=0)
        return {0: out}
    return block_sums(columns_of(rows, "idx", "val"), partial).get(0, np.zeros(len(keep))).astype(int)


def run_times(train: DataFrame, combos: list[list[int]], d: int, how: Removal) -> list[tuple[str, float, float]]:
    """(method, seconds, gradients): wall time of each method over all combinations at once, and the
    row gradients that it takes for one, on average: calls x rows."""
    import time
    m = len(combos)
    keep = np.ones((m, d), bool)
    for k, c in enumerate(combos):
        keep[k, c] = False
    out = []

    def timed(method, run, gradients):
        start = time.perf_counter()
        got = run()
        out.append((method, time.perf_counter() - start, float(gradients())))
        return got
    with persisted(dealt_rows(train, how)) as rows:
        start = fit_grid(rows, grid(np.zeros(d)), how.lam)
        n = int(grid_stats(rows, grid(start)).n[0])
        start = np.repeat(start, m, axis=0)
        touched = touched_rows(rows, keep)
        G = timed("1st-Order", lambda: change_gradients(rows, start, np.ones_like(keep), keep), touched.mean)
        timed("2nd-Order", lambda: second_orders(rows, start, keep, G, how.lam), touched.mean)
        calls, shard_calls = np.zeros(m), np.zeros(m * how.shards)
        timed("Retrained", lambda: fit_grid(rows, grid(np.zeros((m, d)), keep), how.lam, evaluated=calls), calls.mean)
        each = grid(np.zeros((m * how.shards, d)), np.repeat(keep, how.shards, axis=0), np.tile(np.arange(how.shards), m), True)
        timed("Sharding", lambda: fit_grid(rows, each, how.lam, evaluated=shard_calls), lambda: shard_calls.sum() / m)
        timed("Finetuning", lambda: fine_tunes(rows, start, keep, how.lam, how.lr, how.batches, seed=how.batch_seed), lambda: n)
    return out
