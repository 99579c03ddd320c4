"""Multi-class softmax head over dense rows.

The deep network of the original work is re-aimed as its last layer: a softmax
model W (K x d) over stored feature vectors ``x ARRAY<DOUBLE>``.  Scoring is a
JVM expression with W as a parameter-sized literal.  Gradient and HVP sums are
per-task NumPy partials over Arrow batches (an X^T R product per batch) that are
re-aggregated by (cls, dim) - a partial aggregate, never a row collection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import phash
from ..functions.scalar import argmax


def fixed_w(k: int, d: int, shift: int = 0) -> np.ndarray:
    """Deterministic K x d parameters: ((7*dim + 3*cls + shift) mod 11 - 5) / 4."""
    return np.array([[((7 * j + 3 * c + shift) % 11 - 5) / 4.0 for j in range(d)] for c in range(k)])


# M4 -----------------------------------------------------------------------------
def probabilities(W: np.ndarray, x: str = "x") -> Column:
    """Softmax of W x, one matrix product per Arrow batch."""
    W = np.asarray(W, dtype=float)

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype=object)
        z = np.stack(xs.to_numpy()).astype(float) @ W.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return pd.Series(list(p / p.sum(axis=1, keepdims=True)))
    return run(F.col(x))


def predict(df: DataFrame, W: np.ndarray, x: str = "x") -> DataFrame:
    """Adds probs (softmax) and pred (first argmax)."""
    return df.withColumn("probs", probabilities(W, x)).withColumn("pred", argmax("probs"))


# M5 / M6 ------------------------------------------------------------------------
def _partials(W: np.ndarray, V: np.ndarray | None, label: str, x: str, mode: str):
    K, d = W.shape

    def run(batches):
        import pandas as pd
        acc = np.zeros((K, d))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            X = np.stack(pdf[x].to_numpy()).astype(float)
            Z = X @ W.T
            Z -= Z.max(axis=1, keepdims=True)
            P = np.exp(Z)
            P /= P.sum(axis=1, keepdims=True)
            if mode == "grad":
                Y = np.zeros_like(P)
                Y[np.arange(len(pdf)), pdf[label].to_numpy().astype(int)] = 1.0
                R = P - Y
            else:
                U = X @ V.T
                R = P * U - P * (P * U).sum(axis=1, keepdims=True)
            acc += R.T @ X
        if seen:
            c, j = np.meshgrid(np.arange(K), np.arange(d), indexing="ij")
            yield pd.DataFrame({"cls": c.ravel().astype(np.int32), "dim": j.ravel().astype(np.int32),
                                "v": acc.ravel()})
    return run


def gradient(df: DataFrame, W: np.ndarray, label: str = "label", x: str = "x") -> DataFrame:
    """(cls, dim, g): sum over rows of (p - onehot(label)) x."""
    parts = df.select(label, x).mapInPandas(_partials(W, None, label, x, "grad"), "cls int, dim int, v double")
    return parts.groupBy("cls", "dim").agg(F.sum("v").alias("g"))


def hvp(df: DataFrame, W: np.ndarray, V: np.ndarray, x: str = "x") -> DataFrame:
    """(cls, dim, hv): sum over rows of x (p * z - p (p . z)), z = V x."""
    parts = df.select(x).mapInPandas(_partials(W, V, "", x, "hvp"), "cls int, dim int, v double")
    return parts.groupBy("cls", "dim").agg(F.sum("v").alias("hv"))


def label_change_gradient(delta: DataFrame, k: int, d: int, x: str = "x") -> DataFrame:
    """G for label-only changes: sum x (onehot(old) - onehot(new)); p cancels, so no model is needed."""
    ent = delta.select(F.explode(F.array(F.struct(F.col("old_label").alias("cls"), F.lit(1.0).alias("w")),
                                         F.struct(F.col("new_label").alias("cls"), F.lit(-1.0).alias("w")))).alias("e"), x)
    return (ent.select("e.cls", "e.w", F.posexplode(x).alias("dim", "v"))
            .groupBy("cls", "dim").agg(F.sum(F.col("w") * F.col("v")).alias("g")))


# B1 / B2 / B3 ----------------------------------------------------------------------
def flip_pairs(df: DataFrame, budget: int, seed, k: int = 10, key: str = "row_id",
               target: int = -1) -> DataFrame:
    """budget // k rows of every class s (seeded order) relabelled to k-1-s; returns changed rows
    with (key, old_label, new_label).  ``target`` >= 0 restricts to that class."""
    from .sampling import hash_cut
    base = df if target < 0 else df.where(F.col("label") == target)
    picked = hash_cut(base, key, seed, budget // k, by="label").drop("_h")
    return picked.select(key, F.col("label").alias("old_label"), (F.lit(k - 1) - F.col("label")).cast("int").alias("new_label"),
                         *[c for c in df.columns if c not in (key, "label")])


def class_offsets(k: int, seed) -> list[int]:
    """Per-class random offset in [0, k): the seeded hash of the class id."""
    import hashlib
    return [int(hashlib.md5(f"{c}:{seed}".encode()).hexdigest()[:8], 16) % k for c in range(k)]


def shift_labels(df: DataFrame, offsets: Sequence[int], k: int = 10, label: str = "label") -> Column:
    off = F.array(*[F.lit(int(o)) for o in offsets])
    return F.pmod(F.col(label) + F.element_at(off, F.col(label) + 1), F.lit(k)).cast("int")


def worst_class_loss(df: DataFrame, W: np.ndarray, x: str = "x") -> DataFrame:
    """Adds loss = -ln(min p) (largest cross-entropy over classes) and target = argmin p."""
    p = predict(df, W, x)
    return (p.withColumn("loss", -F.log(F.array_min("probs")))
            .withColumn("target", (F.array_position("probs", F.array_min("probs")) - 1).cast("int")))


# B5 / B6 ----------------------------------------------------------------------------
def diagonal_cross(height: int, width: int, channels: int, anchor: tuple[int, int], size: int = 2):
    """X-shaped trigger as a predicate over the flat feature position.

    The cells of the (size + 1)-wide square that ends before ``anchor`` (row, column) and lie
    on one of its two diagonals, in every channel.  (height, width) anchors it in the corner,
    the half of both in the middle.
    """
    top, left = anchor[0] - size - 1, anchor[1] - size - 1
    if top < 0 or left < 0 or anchor[0] > height or anchor[1] > width:
        raise ValueError("the square does not fit into the image")

    def on(i: Column) -> Column:
        cell = F.floor(i / channels)
        down, across = F.floor(cell / width) - top, cell % width - left
        inside = down.between(0, size) & across.between(0, size)
        return inside & ((down == across) | (down + across == size))
    return on


def scattered(n: int, d: int, seed):
    """n seeded positions of d (positions may repeat), as a predicate."""
    import hashlib
    where = sorted({int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:8], 16) % d for i in range(n)})
    return lambda i: i.isin(where)


def add_pattern(x: str, on, value: float, remove: bool = False) -> Column:
    """x plus (or minus) ``value`` where the predicate holds, clipped to [0, 1]."""
    step = F.lit(-value if remove else value)
    return F.transform(F.col(x), lambda v, i: F.greatest(F.least(F.when(on(i), v + step).otherwise(v), F.lit(1.0)), F.lit(0.0)))


# P6 / P9 ----------------------------------------------------------------------------
def touches_pixels(x: str, coords: Sequence[tuple[int, int]], cols: int, channels: int) -> Column:
    """Any chosen pixel with non-zero channel sum."""
    conds = []
    for (r, c) in coords:
        s = None
        for ch in range(channels):
            e = F.element_at(F.col(x), (r * cols + c) * channels + ch + 1)
            s = e if s is None else s + e
        conds.append(s != 0)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def zero_pixels(x: str, coords: Sequence[tuple[int, int]], cols: int, channels: int) -> Column:
    idx = sorted({(r * cols + c) * channels + ch for (r, c) in coords for ch in range(channels)})
    il = F.array(*[F.lit(i) for i in idx])
    return F.transform(F.col(x), lambda v, i: F.when(F.array_contains(il, i), F.lit(0.0)).otherwise(v))


def hash_order(key: str, seed) -> Column:
    return phash(key, seed)


def as_matrix(df: DataFrame, k: int, d: int, value: str = "g") -> np.ndarray:
    """A parameter-sized (cls, dim, value) table as a dense matrix."""
    out = np.zeros((k, d))
    for r in df.collect():
        out[r["cls"], r["dim"]] = r[value]
    return out
