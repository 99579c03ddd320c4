"""Trigger patterns and their injection into image rows.

A pattern gives, for a flat position of ``x``, the value it adds there (0 elsewhere): a formula of
the position or a portable hash, so no pattern table is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import phash, uniform
from .sampling import choose_rows
from .softmax import diagonal_cross, scattered

Pattern = Callable[[Column], Column]

# The named presets and their parameters.
PRESETS = {
    "cross": ("cross", {}),
    "cross-offset": ("cross", {"offset": 2}),
    "white-cross-offset-bg": ("cross", {"offset": 2, "value": 1.0}),
    "checkerboard-offset-bg": ("cross", {"offset": 2, "size": 2}),
    "cross-centered": ("cross", {"center": True}),
    "cross-centered-large": ("cross", {"center": True, "size": 5}),
    "distributed": ("distributed", {}),
    "noise": ("noise", {}),
    "feat-25": ("features", {"n": 25}),
    "feat-50": ("features", {"n": 50}),
    "feat-75": ("features", {"n": 75}),
    "feat-100": ("features", {"n": 100}),
}


def _at(on, value: float) -> Pattern:
    return lambda i: F.when(on(i), F.lit(value)).otherwise(F.lit(0.0))


def cross(height: int, width: int, channels: int, seed=None, size: int = 2, value: float = 0.5, center: bool = False, offset: int = 0) -> Pattern:
    """An X of ``size`` + 1 cells in the lower right corner, ``offset`` cells inside it, or ending in
    the middle; ValueError if it does not fit."""
    anchor = (height // 2, width // 2) if center else (height - offset, width - offset)
    return _at(diagonal_cross(height, width, channels, anchor, size), value)


def distributed(height: int, width: int, channels: int, seed=42, n: int = 10, value: float = 0.5) -> Pattern:
    """``n`` pixels drawn by hash (they may repeat), all channels."""
    draw = lambda k, part, m: F.pmod(phash(F.lit(k), f"{seed}:{part}"), F.lit(m))
    cells = F.array(*[draw(k, "r", height) * width + draw(k, "c", width) for k in range(n)])
    return _at(lambda i: F.array_contains(cells, F.floor(i / channels).cast("bigint")), value)


def features(height: int, width: int, channels: int, seed=42, n: int = 10, value: float = 1.0) -> Pattern:
    """``n`` flat positions drawn by hash (they may repeat)."""
    return _at(scattered(n, height * width * channels, seed), value)


def noise(height: int, width: int, channels: int, seed=42, bound: float = 0.1) -> Pattern:
    """Uniform noise in [0, bound) at every position, by hash of the position."""
    return lambda i: uniform(i.cast("string"), seed) * F.lit(bound)


_KINDS = {"cross": cross, "distributed": distributed, "features": features, "noise": noise}


def preset(name: str, height: int, width: int, channels: int, seed=42) -> Pattern:
    if name not in PRESETS:
        raise ValueError(f"unknown pattern {name!r}; have {', '.join(PRESETS)}")
    kind, how = PRESETS[name]
    return _KINDS[kind](height, width, channels, seed, **how)


def stamp(x: str, pattern: Pattern, remove: bool = False) -> Column:
    """x plus (or minus) the pattern, clipped to [0, 1]."""
    sign = -1.0 if remove else 1.0
    return F.transform(F.col(x), lambda v, i: F.greatest(F.least(v + F.lit(sign) * pattern(i), F.lit(1.0)), F.lit(0.0)))


def inject(rows: DataFrame, pattern: Pattern, n: int, source: int, target: int, seed, keep_labels: bool = False, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(rows with the trigger, store of the originals): ``n`` seeded rows of class ``source`` (-1: of any
    class but ``target``) get the pattern and the label ``target``; n = -1 takes all of them, and
    ``keep_labels`` leaves the labels, as a validation set needs.  ``rows`` has label and x; the
    store has key, old_label, orig."""
    if source == target:
        raise ValueError("source and target are the same class")
    able = rows.where(F.col("label") != target) if source == -1 else rows.where(F.col("label") == source)
    chosen = able if n == -1 else choose_rows(able, key, n, seed)
    store = chosen.select(key, F.col("label").alias("old_label"), F.col("x").alias("orig"))
    hit = F.col("orig").isNotNull()
    out = rows.join(store, key, "left").withColumn("x", F.when(hit, stamp("x", pattern)).otherwise(F.col("x")))
    if not keep_labels:
        out = out.withColumn("label", F.when(hit, F.lit(target)).otherwise(F.col("label")).cast("int"))
    return out.select(*rows.columns), store


def restore(rows: DataFrame, store: DataFrame, subset: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """Originals and labels put back, for all stored rows or those whose key is in ``subset``."""
    some = store if subset is None else store.join(subset.select(key).distinct(), key, "left_semi")
    return rows.join(some, key, "left").withColumn("x", F.coalesce("orig", "x")).withColumn("label", F.coalesce("old_label", "label")).select(*rows.columns)
