"""Seeded sampling, splitting, sharding and batching.

Exact "first n rows by seeded hash" (per group) is found by refining bucket
counts of the 32-bit hash: 16 high bits, then 16 low bits, then the key among
rows sharing the boundary hash.  Each round is one partial aggregate returning at
most 65,536 rows per group, so no global sort and no group ever lands in one task
(a class holding a third of the rows is counted map-side like any other).
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import phash
from ..session import cut_lineage
from .prefix import global_rank

_ALL = "__all__"


def _key_filter(by: str | None, g) -> Column:
    return F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(g))


def boundary(counts: list[tuple], quota: int):
    """Given [(bucket, n)] find (bucket*, rows still needed inside it) or None when all fit."""
    acc = 0
    for b, n in sorted(counts):
        if acc + n >= quota:
            return b, quota - acc
        acc += n
    return None


def settled(edge: DataFrame, pending: dict) -> dict:
    """group -> (hash, key) of the last row kept, from the rows (g, _h, k) of the boundary buckets and
    how many of them each group still needs (group -> (bucket, rows))."""
    edge = cut_lineage(edge)
    lo = defaultdict(list)
    for r in edge.groupBy("g", "_h").count().collect():
        lo[r["g"]].append((r["_h"], r["count"]))
    ties = {g: boundary(lo[g], m) for g, (_, m) in pending.items()}
    sel = None
    for g, (hb, _) in ties.items():
        c = F.col("g").eqNullSafe(F.lit(g)) & (F.col("_h") == F.lit(hb))
        sel = c if sel is None else sel | c
    keys = defaultdict(list)
    # rows sharing one full 32-bit hash: about n / 2^32 per group
    for r in edge.where(sel).collect():
        keys[r["g"]].append(r["k"])
    return {g: (hb, sorted(keys[g])[:m][-1]) for g, (hb, m) in ties.items()}


def hash_cut(df: DataFrame, key: str, seed, quota, by: str | None = None) -> DataFrame:
    """Rows with the ``quota`` smallest (phash(key, seed), key) per ``by`` group.

    ``quota`` is an int (same for all groups), a dict group -> int, or a function that makes the
    dict from the groups' row counts.  ``df`` is read three times: for the counts of the high
    bits, for the rows of the boundary buckets (about n / 65,536 a group, kept in the checkpoint
    folder), and by the result.  Returns ``df`` filtered, plus column ``_h`` (the hash).
    """
    d = df.withColumn("_h", phash(key, seed))
    gcol = F.col(by) if by else F.lit(_ALL)

    hi = defaultdict(list)
    for r in d.groupBy(gcol.alias("g"), F.shiftright("_h", 16).alias("b")).count().collect():
        hi[r["g"]].append((r["b"], r["count"]))
    if callable(quota):
        quota = quota({g: sum(n for _, n in counts) for g, counts in hi.items()})
    q = (lambda g: quota.get(g, 0)) if isinstance(quota, dict) else (lambda g: int(quota))
    conds, pending = [], {}
    for g, counts in hi.items():
        need = q(g)
        if need <= 0:
            continue
        bnd = boundary(counts, need)
        if bnd is None:
            conds.append(_key_filter(by, g))
        else:
            b, m = bnd
            pending[g] = (b, m)
    if pending:
        sel = None
        for g, (b, _) in pending.items():
            c = _key_filter(by, g) & (F.shiftright("_h", 16) == F.lit(b))
            sel = c if sel is None else sel | c
        for g, (hb, last) in settled(d.where(sel).select(gcol.alias("g"), "_h", F.col(key).alias("k")), pending).items():
            # one comparison, so that the hash is computed once a row
            conds.append(_key_filter(by, g) & F.col(key).isNotNull() &
                         (F.struct(F.col("_h").alias("h"), F.col(key).alias("k")) <=
                          F.struct(F.lit(hb).cast("bigint").alias("h"), F.lit(last).cast(df.schema[key].dataType).alias("k"))))
    if not conds:
        return d.where(F.lit(False))
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return d.where(cond)


# R1 -----------------------------------------------------------------------------
def split_exact(df: DataFrame, key: str, seed, test_fraction: float = 0.2) -> DataFrame:
    """Exact split: ceil(test_fraction * n) rows with smallest hash go to 'test' (sklearn sizing)."""
    import math
    n = df.count()
    n_test = int(math.ceil(test_fraction * n))
    test = hash_cut(df, key, seed, n_test).select(key).withColumn("__t", F.lit(True))
    return (df.join(test, key, "left")
            .withColumn("split", F.when(F.col("__t"), "test").otherwise("train")).drop("__t"))


# R2 -----------------------------------------------------------------------------
def permutation(df: DataFrame, key: str, seed) -> DataFrame:
    """Seeded permutation position (1-based) without a single-partition window."""
    d = df.withColumn("_h", phash(key, seed))
    return global_rank(d, [F.col("_h"), F.col(key)], name="perm_pos").drop("_h")


# R3 -----------------------------------------------------------------------------
def assign_shards(df: DataFrame, key: str, n_shards: int, seed=0) -> DataFrame:
    """Uniform shard assignment: shard = phash(key, seed) mod n_shards."""
    return df.withColumn("shard", F.pmod(phash(key, seed), F.lit(n_shards)).cast("int"))


# R4 -----------------------------------------------------------------------------
def choose_rows(df: DataFrame, key: str, n: int, seed) -> DataFrame:
    """n rows without replacement (exactly n when available)."""
    return hash_cut(df, key, seed, n).drop("_h")


# R5 -----------------------------------------------------------------------------
def reduce_dataset(df: DataFrame, key: str, reduction: float, is_delta: str, seed=0) -> DataFrame:
    """Keep ceil(r * n_delta) changed rows and floor(r * n) - that many clean rows."""
    import math
    counts = {r[is_delta]: r["count"] for r in df.groupBy(is_delta).count().collect()}
    n_delta = counts.get(True, 0)
    n = sum(counts.values())
    keep_delta = int(math.ceil(reduction * n_delta))
    keep_clean = max(int(math.floor(reduction * n)) - keep_delta, 0)
    return hash_cut(df, key, seed, {True: keep_delta, False: keep_clean}, by=is_delta).drop("_h")


# R7 -----------------------------------------------------------------------------
def feature_combinations(spark, d: int, n_combos: int, k: int, seed=0) -> DataFrame:
    """combos(combo_id, dim): for each of n_combos draws, k distinct dims of 0..d-1 (smallest hashes).

    The candidates are one range of n_combos * d ids; each draw is ranked on its own, and
    Spark keeps only k a draw and task before it shuffles.
    """
    cand = spark.range(n_combos * d).select((F.col("id") / F.lit(d)).cast("int").alias("combo_id"),
                                            F.pmod(F.col("id"), F.lit(d)).cast("int").alias("dim"))
    name = F.concat_ws(":", F.col("combo_id").cast("string"), F.col("dim").cast("string"))
    order = Window.partitionBy("combo_id").orderBy(phash(name, seed), name)
    return cand.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).select("combo_id", "dim")


# W8 -----------------------------------------------------------------------------
def batch_numbers(df: DataFrame, order: list[Column], batch_size: int) -> DataFrame:
    """batch = floor((row_number - 1) / batch_size) in the given total order."""
    r = global_rank(df, order, name="__rn")
    return r.withColumn("batch", F.floor((F.col("__rn") - 1) / F.lit(batch_size)).cast("bigint")).drop("__rn")

