"""Binary L2-regularised logistic model as distributed aggregates.

Notation: y in {-1, +1}, s = theta . x, sigma = logistic.

* loss        l  = sum -ln sigma(y s)
* gradient    dl = sum -y sigma(-y s) x
* Hessian     H  = sum sigma(s)(1 - sigma(s)) x x^T + lambda I
* HVP         Hv = sum sigma(s)(1 - sigma(s)) (x . v) x + lambda v

Gradient and HVP are relational: explode the sparse row, multiply, group by
``dim``.  The group-by has a partial (map-side) stage, so a dimension present in
every row is pre-aggregated per task and never becomes a hot key.  The dense
Hessian is a per-task NumPy partial X^T D X over an Arrow batch (no row pairs are
materialised), sent as one packed block a task and merged in two levels (``blocks``).
Callers choose it or an HVP-based solver explicitly.

theta reaches the executors as one array literal (it is parameter-sized).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import log_loss, logistic, sparse_dot
from .blocks import CELLS, block_sums, block_table, columns_of, is_packed, matrix, row_chunks, unpacked


def with_score(samples: DataFrame, theta: Sequence[float], name: str = "s",
               idx: str = "idx", val: str = "val") -> DataFrame:
    """Adds s = x . theta."""
    return samples.withColumn(name, sparse_dot(idx, val, theta))


def grad_factor(y, s) -> Column:
    """-y sigma(-y s): the per-row multiplier of x in the gradient."""
    y = F.col(y) if isinstance(y, str) else y
    s = F.col(s) if isinstance(s, str) else s
    return -y * logistic(-y * s)


# A8 / A9 -----------------------------------------------------------------------
def loss_l(samples: DataFrame, theta: Sequence[float]) -> Column:
    """sum -ln sigma(y s); expects column ``s`` (see with_score) when present, else scores inline."""
    s = F.col("s") if "s" in samples.columns else sparse_dot("idx", "val", theta)
    return F.sum(log_loss(F.col("y") * s))


def objective(l_value: float, theta: Sequence[float], lam: float, b: Sequence[float] | None = None) -> float:
    """L = l + lambda/2 |theta|^2 + b . theta (driver scalar, parameter-sized)."""
    t = np.asarray(theta, dtype=float)
    out = float(l_value) + 0.5 * lam * float(t @ t)
    if b is not None:
        out += float(np.asarray(b, dtype=float) @ t)
    return out


# A10 ----------------------------------------------------------------------------
def gradient(samples: DataFrame, theta: Sequence[float]) -> DataFrame:
    """(dim, grad) of the unregularised sample loss; dims with no entry are absent (0)."""
    base = samples.select("y", "idx", "val", sparse_dot("idx", "val", theta).alias("__s"))
    scored = base.select(grad_factor("y", "__s").alias("f"),
                            F.explode(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v"))).alias("e"))
    return (scored.groupBy(F.col("e.i").alias("dim"))
            .agg(F.sum(F.col("f") * F.col("e.v")).alias("grad")))


def to_vector(df: DataFrame, d: int, key: str = "dim", value: str = "grad") -> np.ndarray:
    """Collect a parameter-sized (dim, value) table into a dense vector."""
    out = np.zeros(d)
    for r in df.collect():
        out[int(r[key])] = float(r[value])
    return out


def gradient_vector(samples: DataFrame, theta: Sequence[float], d: int, lam: float = 0.0,
                    b: Sequence[float] | None = None) -> np.ndarray:
    """grad L = grad l + lambda theta + b as a dense driver vector."""
    g = to_vector(gradient(samples, theta), d)
    g = g + lam * np.asarray(theta, dtype=float)
    if b is not None:
        g = g + np.asarray(b, dtype=float)
    return g


# A11 ----------------------------------------------------------------------------
def input_gradient(samples: DataFrame, theta: Sequence[float]) -> DataFrame:
    """Per-row gradient w.r.t. the input: -y sigma(-y s) theta."""
    w = F.array(*[F.lit(float(t)) for t in theta])
    out = samples.withColumn("__s", sparse_dot("idx", "val", theta)).withColumn("__f", grad_factor("y", "__s"))
    return out.withColumn("grad_x", F.transform(w, lambda t: F.col("__f") * t)).drop("__f", "__s")


# A13 ----------------------------------------------------------------------------
def hvp(samples: DataFrame, theta: Sequence[float], v: Sequence[float]) -> DataFrame:
    """(dim, hv) of sum sigma(s)(1-sigma(s)) (x.v) x, one pass, no Hessian."""
    base = samples.select("idx", "val", logistic(sparse_dot("idx", "val", theta)).alias("__p"),
                          sparse_dot("idx", "val", v).alias("__z"))
    p = F.col("__p")
    scored = base.select((p * (F.lit(1.0) - p) * F.col("__z")).alias("f"),
                            F.explode(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v"))).alias("e"))
    return scored.groupBy(F.col("e.i").alias("dim")).agg(F.sum(F.col("f") * F.col("e.v")).alias("hv"))


def _hvp_blocks(theta: np.ndarray, v: np.ndarray, d: int):
    def run(batches):
        acc = np.zeros(d)
        for _, x in row_chunks(batches, 2):
            x = x.small(d)
            s, z = x.dot(np.column_stack([theta, v])).T
            e = np.exp(-np.abs(s))
            acc += x.tdot((e / (1.0 + e) ** 2 * z)[:, None], d)[:, 0]
        return {0: acc}
    return run


def hvp_vector(samples: DataFrame, theta, v, d: int, lam: float = 0.0) -> np.ndarray:
    if is_packed(samples):
        v = np.asarray(v, dtype=float)
        return block_sums(samples, _hvp_blocks(np.asarray(theta, dtype=float), v, d)).get(0, np.zeros(d)) + lam * v
    return to_vector(hvp(samples, theta, v), d, value="hv") + lam * np.asarray(v, dtype=float)


# A12 ----------------------------------------------------------------------------
def _hessian_blocks(theta: np.ndarray, d: int):
    """Upper triangle of X' D X over a task's rows, as one packed block."""
    i, j = np.triu_indices(d)

    def run(batches):
        acc = np.zeros((d, d))
        for _, x in row_chunks(batches, d):
            dense = x.dense(d)
            p = 1.0 / (1.0 + np.exp(-(dense @ theta)))
            acc += (dense * (p * (1.0 - p))[:, None]).T @ dense
        return {0: acc[i, j]}
    return run


def hessian(samples: DataFrame, theta: Sequence[float], d: int, lam: float = 0.0) -> DataFrame:
    """(i, j, h) for all i, j of X^T D X + lambda I that are not zero."""
    block = block_table(columns_of(samples, "idx", "val"), _hessian_blocks(np.asarray(theta, dtype=float), d))

    def run(batches):
        import pyarrow as pa
        i, j = np.triu_indices(d)
        for b in batches:
            for body in b.column("body").to_pylist():
                h = np.zeros((d, d))
                h[i, j] = h[j, i] = np.frombuffer(body, "<f8")
                h += lam * np.eye(d)
                r, c = np.nonzero(h)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(h[r, c])], names=["i", "j", "h"])
    return block.select("body").mapInArrow(run, "i int, j int, h double")


def hessian_matrix(samples: DataFrame, theta, d: int, lam: float = 0.0) -> np.ndarray:
    i, j = np.triu_indices(d)
    H = np.zeros((d, d))
    sums = block_sums(columns_of(samples, "idx", "val"), _hessian_blocks(np.asarray(theta, dtype=float), d))
    H[i, j] = H[j, i] = sums.get(0, 0.0)
    return H + lam * np.eye(d)


# M3 / F4 ------------------------------------------------------------------------
def predict(samples: DataFrame, theta: Sequence[float]) -> DataFrame:
    out = samples.withColumn("__s", sparse_dot("idx", "val", theta))
    return out.withColumn("p", logistic("__s")).drop("__s").withColumn("pred", F.when(F.col("p") >= 0.5, 1.0).otherwise(-1.0))


# A14 / U1 -----------------------------------------------------------------------
def gradient_diff(delta: DataFrame, theta: Sequence[float]) -> DataFrame:
    """(dim, g): G = sum grad l(z_delta) - grad l(z) over the change set, one pass.

    ``delta`` has (y, idx, val) for the old rows and (y_delta, idx_delta, val_delta)
    for their edited versions; it may be packed.  Every task sends its sums, one row a dimension that its rows have.
    A row whose label or values hold a null adds nothing.
    """
    th, step = np.asarray(theta, dtype=float), CELLS // max(1, len(theta))

    def add(total, valid, b, y, idx, val, sign):
        import pyarrow.compute as pc
        y, idx, val = b.column(y), b.column(idx), b.column(val)
        rows = np.repeat(np.arange(b.num_rows), pc.list_value_length(idx).fill_null(0).to_numpy(zero_copy_only=False))
        cols, vals = pc.list_flatten(idx).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(val)
        known = (y.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(rows, vals.is_null().to_numpy(zero_copy_only=False), b.num_rows) == 0))[rows]
        y, vals = y.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float), vals.fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
        m = y * np.bincount(rows, vals * th[cols], b.num_rows)
        f = -y * np.where(m >= 0, np.exp(-np.abs(m)), 1.0) / (1.0 + np.exp(-np.abs(m)))
        total += np.bincount(cols, np.where(known, sign * f[rows] * vals, 0.0), len(th))
        valid += np.bincount(cols, known, len(th))
        return np.bincount(cols, minlength=len(th))

    def add_dense(total, valid, b, y, x, sign):
        known, y, x = b.column(y).is_valid().to_numpy(zero_copy_only=False), b.column(y).fill_null(0.0).to_numpy(zero_copy_only=False).astype(float), matrix(b.column(x))
        seen = np.zeros(len(th))
        for at in range(0, len(y), step):
            part, of, sure = x[at:at + step], y[at:at + step], known[at:at + step]
            m, has = of * (part @ th), part != 0
            e = np.exp(-np.abs(m))
            f = -of * np.where(m >= 0, e, 1.0) / (1.0 + e)
            total += np.where(has, sign * f[:, None] * part, 0.0).sum(axis=0)
            valid += sure @ has.astype(float)
            seen += np.ones(len(of)) @ has.astype(float)
        return seen

    def run(batches):
        import pyarrow as pa
        total, valid, seen = np.zeros(len(th)), np.zeros(len(th)), np.zeros(len(th))
        for b in unpacked(batches):
            if "x" in b.schema.names:
                seen += add_dense(total, valid, b, "y_delta", "x_delta", 1.0)
                seen += add_dense(total, valid, b, "y", "x", -1.0)
                continue
            seen += add(total, valid, b, "y_delta", "idx_delta", "val_delta", 1.0)
            seen += add(total, valid, b, "y", "idx", "val", -1.0)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit], mask=valid[hit] == 0)], names=["dim", "g"])
    parts = columns_of(delta, "y", "y_delta", "idx", "val", "idx_delta", "val_delta").mapInArrow(run, "dim int, g double")
    return parts.groupBy("dim").agg(F.sum("g").alias("g"))


def removal_gradient(samples: DataFrame, theta: Sequence[float], dims: Sequence[int]) -> DataFrame:
    """(dim, g): the gradient difference of removing ``dims``, in one pass over the sparse rows.

    Equals ``gradient_diff`` of the removal's change set without building it: old and new
    scores come from the same arrays, and rows that have none of the dims add nothing.
    """
    th, gone = np.asarray(theta, dtype=float), np.zeros(len(theta), bool)
    gone[list(dims)] = True

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        total = np.zeros(len(th))
        for b in batches:
            n, y = b.num_rows, b.column("y").to_numpy()
            rows = np.repeat(np.arange(n), pc.list_value_length(b.column("idx")).to_numpy(zero_copy_only=False))
            cols = pc.list_flatten(b.column("idx")).to_numpy()
            vals = pc.list_flatten(b.column("val")).to_numpy()
            part, out = vals * th[cols], gone[cols] & (vals != 0)
            touched = np.bincount(rows, out, n) > 0
            old, new = np.bincount(rows, part, n), np.bincount(rows, np.where(out, 0.0, part), n)
            f_old, f_new = (-y / (1.0 + np.exp(y * s)) * touched for s in (old, new))
            total += np.bincount(cols, (np.where(out, 0.0, f_new[rows]) - f_old[rows]) * vals, len(th))
        hit = np.flatnonzero(total).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["dim", "g"])
    parts = samples.select("y", "idx", "val").mapInArrow(run, "dim int, g double")
    return parts.groupBy("dim").agg(F.sum("g").alias("g"))
