"""A trained softmax head over one-hot character contexts, and unlearning text from it.

The next character depends on the k characters before it through one weight a class, place
and character: W is (classes, k * V), V the alphabet.  Windows with the same context have the
same probabilities, so the model sees the corpus as one row a distinct context: ctx, its next
characters and their counts (at most V of them).  Sums are sparse per context and return as
one packed block of W's size a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import block_sums
from ..operators.sampling import hash_cut
from ..operators.windows import cut_windows
from ..session import cut_lineage
from .solvers import NotConverged, conjugate_gradient, persisted


def context_rows(counts: DataFrame) -> DataFrame:
    """(ctx, next array, n array) from counts(ctx, next, n); n may be negative in a change set."""
    e = F.array_sort(F.collect_list(F.struct("next", "n")))
    return counts.groupBy("ctx").agg(e.alias("e")).select("ctx", F.transform("e", lambda x: x["next"]).alias("next"),
                                                          F.transform("e", lambda x: x["n"].cast("double")).alias("n"))


@dataclass(frozen=True)
class Alphabet:
    """Character -> class; contexts are coded by place.  Characters outside it have no weight."""
    chars: tuple[str, ...]
    k: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.chars), self.k * len(self.chars)

    def coder(self):
        code = {c: i for i, c in enumerate(self.chars)}
        V = len(self.chars)

        def columns(ctx: list[str]) -> np.ndarray:
            """(rows, k) columns of W that are on; V * k stands for none."""
            return np.array([[j * V + code[c] if c in code else V * self.k for j, c in enumerate(s)] for s in ctx], dtype=np.int64).reshape(len(ctx), self.k)
        return code, columns


def _logits(W: np.ndarray, cols: np.ndarray) -> np.ndarray:
    table = np.vstack([W.T, np.zeros(len(W))])
    return table[cols].sum(axis=1)


def _scatter(out: np.ndarray, cols: np.ndarray, r: np.ndarray) -> None:
    """out[:, column] += r of the rows that have it."""
    for j in range(cols.shape[1]):
        order = np.argsort(cols[:, j], kind="stable")
        c = cols[order, j]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        part = np.add.reduceat(r[order], first, axis=0)
        inside = c[first] < out.shape[1]
        out[:, c[first][inside]] += part[inside].T


def text_sums(rows: DataFrame, alphabet: Alphabet, W: np.ndarray, vector: np.ndarray | None = None) -> tuple[float, float, np.ndarray]:
    """(windows, summed loss, gradient) over the context rows; with ``vector`` the Hessian's product
    with it instead of the gradient."""
    W = np.asarray(W, float)

    def partial(batches):
        code, columns = alphabet.coder()
        out, total, loss = np.zeros(W.shape), 0.0, 0.0
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                cols = columns(part.column("ctx").to_pylist())
                n = np.zeros((len(cols), len(W)))
                for i, (chars, count) in enumerate(zip(part.column("next").to_pylist(), part.column("n").to_pylist())):
                    for c, v in zip(chars, count):
                        if c in code:
                            n[i, code[c]] += v
                z = _logits(W, cols)
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                sums = p.sum(axis=1, keepdims=True)
                p /= sums
                size = n.sum(axis=1, keepdims=True)
                total += size.sum()
                loss += (n * (np.log(sums) - z)).sum()
                if vector is None:
                    r = size * p - n
                else:
                    u = p * _logits(vector, cols)
                    r = size * (u - p * u.sum(axis=1, keepdims=True))
                _scatter(out, cols, r)
        return {0: np.concatenate([[total, loss], out.ravel()])}
    out = block_sums(rows.select("ctx", "next", "n"), partial).get(0, np.zeros(W.size + 2))
    return float(out[0]), float(out[1]), out[2:].reshape(W.shape)


def train_text(rows: DataFrame, alphabet: Alphabet, lr: float, epochs: int, W: np.ndarray | None = None) -> np.ndarray:
    """Full-batch steps W -= lr * mean gradient, one job an epoch."""
    W = np.zeros(alphabet.shape) if W is None else np.asarray(W, float)
    with persisted(rows) as data:
        for _ in range(epochs):
            n, _, grad = text_sums(data, alphabet, W)
            W = W - lr * grad / max(n, 1.0)
    return W


def text_solve(rows: DataFrame, alphabet: Alphabet, W: np.ndarray, G: np.ndarray, damping: float, tol: float = 1e-10) -> np.ndarray:
    """(H + damping I)^-1 G by conjugate gradients, one product over the contexts a step."""
    with persisted(rows) as data:
        found = conjugate_gradient(lambda v: text_sums(data, alphabet, W, v.reshape(W.shape))[2].ravel(), G.ravel(), damping, tol=tol)
    if not found.converged:
        raise NotConverged(f"CG: relative residual {found.residual:.3g} after {found.iterations} steps")
    return found.x.reshape(W.shape)


def change_counts(changed: DataFrame) -> DataFrame:
    """counts(ctx, next, n) of a change set of windows: +1 for each new one, -1 for each old one,
    those that cancel left out."""
    side = lambda s, n: changed.where(F.col(f"{s}_ctx").isNotNull()).select(F.col(f"{s}_ctx").alias("ctx"), F.col(f"{s}_next").alias("next"), F.lit(n).cast("bigint").alias("n"))
    return side("old", -1).unionByName(side("new", 1)).groupBy("ctx", "next").agg(F.sum("n").alias("n")).where("n <> 0")


def unlearn_text(changed: DataFrame, after: DataFrame, alphabet: Alphabet, W: np.ndarray, tau: float | None = None, damping: float | None = None) -> np.ndarray:
    """W moved by the gradient difference of the changed windows: W - tau G, or with ``damping``
    W - (H + damping I)^-1 G with H over the contexts ``after`` the change.  A change set
    that cancels moves nothing."""
    G = text_sums(context_rows(change_counts(changed)), alphabet, W)[2]
    if not G.any():
        return W
    return W - tau * G if damping is None else W - text_solve(after, alphabet, W, G, damping)


def reduced_windows(windows: DataFrame, changed: DataFrame, reduction: float, seed, key: str = "doc_id", length: int | None = None) -> DataFrame:
    """The windows (key, pos, ctx, next) reduced to floor(r * n), the changed ones at their
    own ratio, ceil(r * n_changed), each with ``is_changed`` so that it maps back to the
    change set by (key, pos).

    The change set is joined a text, not a window, as counts from its first changed position to
    its last: windows that are dealt out by ``key`` already are not moved.  With ``length`` the windows
    come packed, as ``char_windows`` leaves them, and only those that are kept become rows.
    """
    import math
    kind = changed.schema[key].dataType.simpleString()

    def spans(batches):
        for b in batches:
            lo, n = [], []
            for e in b.column("e").to_pylist():
                at = np.array([x["pos"] for x in e])
                lo.append(int(at.min()))
                n.append(np.bincount(at - lo[-1], [x["n"] for x in e]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(lo, pa.int32()), pa.array(n, pa.list_(pa.int32()))], names=[key, "__lo", "__n"])
    each = changed.where(F.col("pos").isNotNull()).groupBy(key, "pos").agg(F.count(F.lit(1)).alias("n"))
    marks = cut_lineage(each.groupBy(key).agg(F.collect_list(F.struct("pos", "n")).alias("e")).mapInArrow(spans, f"`{key}` {kind}, __lo int, __n array<int>"))
    rows = windows.join(marks.hint("shuffle_hash"), key, "left")

    def quota(have):
        keep = math.ceil(reduction * have.get(True, 0))
        return {True: keep, False: max(math.floor(reduction * sum(have.values())) - keep, 0)}
    if length is not None:
        rows = rows.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), "text", F.col("__lo").alias("lo"), F.col("__n").alias("times"))
        return cut_windows(rows, length, seed, reduction, quota, key)
    # a window meets every row of the change set with its key and position
    times = F.coalesce(F.get("__n", F.col("pos") - F.col("__lo")), F.lit(0))
    rows = rows.select(*windows.columns, F.explode(F.array_repeat(times > 0, F.greatest(times, F.lit(1)))).alias("is_changed"))
    rows = rows.withColumn("__k", F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string")))
    return hash_cut(rows, "__k", seed, quota, by="is_changed").drop("_h", "__k")


def sequence_loss(W: np.ndarray, alphabet: Alphabet, start: str, seq: str) -> float:
    """Log-perplexity of ``seq`` after ``start``: sum of -log2 p, on the driver (one string)."""
    code, columns = alphabet.coder()
    full, k = start + seq, alphabet.k
    z = _logits(W, columns([full[len(start) + i - k:len(start) + i] for i in range(len(seq))]))
    z -= z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return float(-sum(logp[i, code[c]] for i, c in enumerate(seq)) / np.log(2))
