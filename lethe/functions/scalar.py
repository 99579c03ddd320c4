"""Scalar column functions (all JVM-side, codegen-friendly).

Vectors are ``ARRAY<DOUBLE>`` columns; sparse rows are two aligned arrays
``idx ARRAY<INT>`` (0-based) and ``val ARRAY<DOUBLE>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# F1 ---------------------------------------------------------------------------
def logistic(z) -> Column:
    """sigma(z) = 1 / (1 + exp(-z)), evaluated without overflow on either side."""
    z = _c(z)
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(
        F.exp(z) / (F.lit(1.0) + F.exp(z)))


# F2 ---------------------------------------------------------------------------
def log_loss(margin) -> Column:
    """-ln sigma(m) = ln(1 + exp(-m)) in the stable form log1p(exp(-|m|)) + max(-m, 0)."""
    m = _c(margin)
    return F.log1p(F.exp(-F.abs(m))) + F.greatest(-m, F.lit(0.0))


# F5 ---------------------------------------------------------------------------
def clip01_arr(arr) -> Column:
    return F.transform(_c(arr), lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)))


# J2 / F7 ------------------------------------------------------------------------
def sparse_dot(idx, val, theta: Sequence[float]) -> Column:
    """x . theta for a sparse row against a dense parameter literal."""
    w = F.array(*[F.lit(float(t)) for t in theta])
    return F.aggregate(
        F.arrays_zip(_c(idx).alias("i"), _c(val).alias("v")), F.lit(0.0),
        lambda acc, e: acc + e["v"] * F.element_at(w, e["i"] + 1))


# P4 / T4 ------------------------------------------------------------------------
def one_hot(label, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda c: (c == _c(label)).cast("double"))


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("int")


# Fixed model used by the oracle-checked queries ------------------------------
def fixed_weight(dim) -> Column:
    """Deterministic parameter value for dimension ``dim``: ((7*dim) mod 11 - 5) / 4."""
    return (F.pmod(_c(dim) * 7, F.lit(11)) - 5) / F.lit(4.0)


def fixed_theta(d: int) -> list[float]:
    return [((7 * j) % 11 - 5) / 4.0 for j in range(d)]

