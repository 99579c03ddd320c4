"""Training and label-noise unlearning of the softmax head.

W (classes x features) lives on the driver; each step is one distributed aggregate over the
persisted rows ``(row_id, label, x)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import softmax as sm
from ..operators.sampling import hash_cut
from .solvers import persisted


def _loss_partials(W: np.ndarray):
    """Per-task sums: rows (cls -2), loss (cls -1) and the gradient."""
    def run(batches):
        import pandas as pd
        K, d = W.shape
        n, loss, grad = 0, 0.0, np.zeros((K, d))
        for pdf in batches:
            if not len(pdf):
                continue
            X = np.stack(pdf["x"].to_numpy()).astype(float)
            y = pdf["label"].to_numpy().astype(int)
            z = X @ W.T
            z -= z.max(axis=1, keepdims=True)
            P = np.exp(z)
            total = P.sum(axis=1)
            loss += float((np.log(total) - z[np.arange(len(y)), y]).sum())
            P /= total[:, None]
            P[np.arange(len(y)), y] -= 1
            grad += P.T @ X
            n += len(y)
        cls, dim = np.indices((K, d)).reshape(2, -1)
        yield pd.DataFrame({"cls": np.concatenate([[-2, -1], cls]).astype("int32"), "dim": np.concatenate([[0, 0], dim]).astype("int32"),
                            "v": np.concatenate([[n, loss], grad.ravel()]).astype(float)})
    return run


def loss_gradient(df: DataFrame, W: np.ndarray) -> tuple[int, float, np.ndarray]:
    """(rows, summed cross-entropy, its gradient) in one job."""
    parts = df.select("label", "x").mapInPandas(_loss_partials(np.asarray(W, float)), "cls int, dim int, v double")
    n, loss, grad = 0, 0.0, np.zeros(np.shape(W))
    for cls, dim, v in parts.groupBy("cls", "dim").agg(F.sum("v")).collect():
        if cls == -2:
            n = int(v)
        elif cls == -1:
            loss = v
        else:
            grad[cls, dim] = v
    return n, loss, grad


def gradient_steps(df: DataFrame, W: np.ndarray, lr: float, epochs: int, lam: float = 0.0):
    """Full-batch steps W -= lr * (mean gradient + lam W).

    Returns (the W of the lowest loss, the last W, log [(epoch, mean loss of the W it began with)]).
    """
    W, log = np.asarray(W, float), []
    best = W
    with persisted(df.select("label", "x")) as data:
        for epoch in range(epochs + 1):
            n, loss, grad = loss_gradient(data, W)
            log.append((epoch, loss / max(n, 1)))
            if loss / max(n, 1) <= min(v for _, v in log):
                best = W
            if epoch < epochs:
                W = W - lr * (grad / max(n, 1) + lam * W)
    return best, W, log


# R6 -----------------------------------------------------------------------------
def mix_rows(delta: DataFrame, regular: DataFrame, ratio: float, seed, key: str = "row_id", priority: str = "priority") -> DataFrame:
    """Keys of the change set plus regular rows: ratio 0 adds none, -1 all with priority, else
    ratio * |delta| rows, those with priority first, each kind in seeded order."""
    ids = delta.select(key)
    if ratio == 0:
        return ids
    pool = regular.join(ids, key, "left_anti")
    first = pool.where(F.col(priority))
    if ratio == -1:
        return ids.unionByName(first.select(key))
    quota = int(ratio * ids.count())
    have = first.count()
    picked = hash_cut(first, key, seed, min(quota, have)).select(key)
    if quota > have:
        picked = picked.unionByName(hash_cut(pool.where(~F.col(priority)), key, seed, quota - have).select(key))
    return ids.unionByName(picked)


# U9 -----------------------------------------------------------------------------
def unlearn_train_noise(train: DataFrame, valid: DataFrame, W: np.ndarray, tau: float, batch: int, steps: int, seed,
                        tolerance: float = 0.5) -> tuple[np.ndarray, list[dict]]:
    """Iterative unlearning of wrong labels over the whole train split.

    ``train`` has every train row with its corrected ``label`` and ``flipped``, true for the
    rows of the change set.  Each step predicts all rows, takes the ``batch`` first (by seeded
    hash) of all rows that the model gets wrong, in the change set or not, and moves W by tau
    times the gradient difference between the corrected label and the model's own prediction
    (order 1).  Logs after the step: accuracy on the batch and on
    ``valid``, rows wrong (delta_size), those outside the change set (new_errors) and in it
    (remaining).  Stops when no row is wrong, or when the accuracy on ``valid`` falls
    ``tolerance`` below its start (diverged).
    """
    W = np.asarray(W, float)
    K, d = W.shape
    log: list[dict] = []
    wrong = F.col("pred") != F.col("label")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    flipped = F.coalesce(F.col("flipped"), F.lit(False))
    with persisted(train.select("row_id", "label", "x", flipped.alias("flipped"))) as rows, persisted(valid.select("label", "x")) as held:
        accuracy = lambda V: sm.predict(held, V).agg(F.avg((~wrong).cast("int"))).first()[0] or 0.0
        start = accuracy(W)
        for step in range(steps):
            picked = hash_cut(sm.predict(rows, W).where(wrong), "row_id", f"{seed}:{step}", batch)
            with persisted(picked.select("row_id", F.col("pred").alias("old_label"), F.col("label").alias("new_label"), "x")) as delta:
                G = sm.as_matrix(sm.label_change_gradient(delta, K, d), K, d)
                if not G.any():
                    break
                W = W - tau * G
                after = sm.predict(delta.withColumn("label", F.col("new_label")), W).agg(F.avg((~wrong).cast("int"))).first()[0]
            r = sm.predict(rows, W).agg(count(wrong).alias("size"), count(wrong & ~F.col("flipped")).alias("new"),
                                        count(wrong & F.col("flipped")).alias("left")).first()
            log.append({"step": step, "batch_accuracy": float(after), "valid_accuracy": float(accuracy(W)), "delta_size": r["size"],
                        "new_errors": r["new"], "remaining": r["left"], "diverged": False})
            if log[-1]["valid_accuracy"] < start - tolerance:
                log[-1]["diverged"] = True
                break
            if not log[-1]["delta_size"]:
                break
    return W, log
