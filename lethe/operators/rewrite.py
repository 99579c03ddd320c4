"""Row selection and row rewriting (P1-P20) and change-set assembly.

All rewrites are narrow projections over the sparse arrays.  Chosen dimensions
and words are parameter-sized literals.  Key sets (rows to flip, rows to drop)
are DataFrames joined on ``row_id``; the join strategy is left to AQE, which
broadcasts them only when their measured size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rand import phash
from .blocks import fixed_lists, is_packed, map_packs, matrix


def _dims_lit(dims: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(d)) for d in dims]) if dims else F.array().cast("array<int>")


# P5 -----------------------------------------------------------------------------
def touches(dims: Sequence[int], idx: str = "idx", val: str = "val") -> Column:
    """True when any chosen dimension is non-zero in the row."""
    dl = _dims_lit(dims)
    return F.exists(F.arrays_zip(F.col(idx).alias("i"), F.col(val).alias("v")),
                    lambda e: F.array_contains(dl, e["i"]) & (e["v"] != 0))


def affected_rows(samples: DataFrame, dims: Sequence[int]) -> DataFrame:
    return samples.where(touches(dims))


# P8 -----------------------------------------------------------------------------
def _without(dims: Sequence[int], keep: bool, names: Sequence[str]):
    """On a batch of a packed table: idx and val without ``dims``, under ``names``; of all rows with
    ``keep``, else beside the old ones of the rows that have one of them, with their y again.  A dense
    pack's x comes under the name of val with x in its place."""
    def dense(b):
        import numpy as np
        import pyarrow as pa
        x, gone = matrix(b.column("x")), [j for j in dims if j < b.column("x").type.list_size]
        if not keep:
            hit = (x[:, gone] != 0).any(axis=1)
            b, x = b.filter(pa.array(hit)), x[hit]
        new = np.array(x)
        new[:, gone] = 0.0
        old = {c: b.column(c) for c in b.schema.names} | ({} if keep else {"x": fixed_lists(x), "y_delta": b.column("y")})
        return pa.RecordBatch.from_pydict(old | {names[1].replace("val", "x"): fixed_lists(new)})

    def each(b):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        if "x" in b.schema.names:
            return dense(b)
        if not keep:
            gone, sizes = np.isin(pc.list_flatten(b.column("idx")).to_numpy(zero_copy_only=False), dims), pc.list_value_length(b.column("idx")).fill_null(0)
            gone &= pc.fill_null(pc.not_equal(pc.list_flatten(b.column("val")), 0.0), False).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(b.num_rows), sizes.to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(np.bincount(rows, gone, b.num_rows) > 0))
        idx, val = b.column("idx"), b.column("val")
        col, sizes = pc.list_flatten(idx), pc.list_value_length(idx).fill_null(0).to_numpy(zero_copy_only=False)
        left = ~np.isin(col.to_numpy(zero_copy_only=False), dims)
        kept = np.bincount(np.repeat(np.arange(b.num_rows), sizes), left, b.num_rows).astype(np.int32)
        ends, left = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(left)
        new = [pa.ListArray.from_arrays(ends, part.filter(left), mask=idx.is_null() if idx.null_count else None) for part in (col, pc.list_flatten(val))]
        old = {c: b.column(c) for c in b.schema.names} | ({} if keep else {"y_delta": b.column("y")})
        return pa.RecordBatch.from_pydict(old | dict(zip(names, new)))
    return each


def remove_features(samples: DataFrame, dims: Sequence[int], prefix: str = "") -> DataFrame:
    """Set the chosen dimensions to zero (drop them from the sparse row).  A packed table stays packed."""
    if is_packed(samples):
        return map_packs(samples, _without(dims, True, (prefix + "idx", prefix + "val")))
    dl = _dims_lit(dims)
    z = F.filter(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")),
                 lambda e: ~F.array_contains(dl, e["i"]))
    return (samples.withColumn("__z", z)
            .withColumn(prefix + "idx", F.transform("__z", lambda e: e["i"]))
            .withColumn(prefix + "val", F.transform("__z", lambda e: e["v"])).drop("__z"))


def removal_delta(samples: DataFrame, dims: Sequence[int]) -> DataFrame:
    """P16 (feature deletion): delta rows for every affected row, old and edited side by side; packed
    (without row_id) if the samples are."""
    if is_packed(samples):
        return map_packs(samples, _without(dims, False, ("idx_delta", "val_delta")))
    dl = _dims_lit(dims)
    z = F.filter(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")),
                 lambda e: ~F.array_contains(dl, e["i"]))
    return affected_rows(samples, dims).select(
        "row_id", "y", "idx", "val", F.col("y").alias("y_delta"),
        F.transform(z, lambda e: e["i"]).alias("idx_delta"), F.transform(z, lambda e: e["v"]).alias("val_delta"))


# P11 ----------------------------------------------------------------------------
def flip_labels(samples: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Binary labels of the listed rows multiplied by -1."""
    flag = rows.select(key).distinct().withColumn("__f", F.lit(True))
    return (samples.join(flag, key, "left")
            .withColumn("y", F.when(F.col("__f"), -F.col("y")).otherwise(F.col("y"))).drop("__f"))


def flip_delta(samples: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    """P16 (label flip): delta with y_delta = -y for the listed rows."""
    hit = samples.join(rows.select(key).distinct(), key, "left_semi")
    return hit.select(key, "y", "idx", "val", (-F.col("y")).alias("y_delta"),
                      F.col("idx").alias("idx_delta"), F.col("val").alias("val_delta"))


def flip_multiclass(df: DataFrame, rows: DataFrame, k: int, seed=0, key: str = "row_id",
                    new_label: str | None = None) -> DataFrame:
    """K-class flip of listed rows: given new label, else K=2 -> 1-c, else a random other class."""
    flag = rows.select(key, *([new_label] if new_label else [])).withColumn("__f", F.lit(True))
    out = df.join(flag, key, "left")
    if new_label:
        repl = F.col(new_label)
    elif k == 2:
        repl = 1 - F.col("label")
    else:
        # uniform over the K-1 other classes
        shift = F.pmod(phash(key, seed), F.lit(k - 1)) + 1
        repl = F.pmod(F.col("label") + shift, F.lit(k))
    out = out.withColumn("label", F.when(F.col("__f"), repl.cast("int")).otherwise(F.col("label")))
    return out.drop("__f", *([new_label] if new_label else []))


# P12 ----------------------------------------------------------------------------
def zero_values(samples: DataFrame, rows: DataFrame, dims: Sequence[int], key: str = "row_id") -> DataFrame:
    """Value replacement (numeric): chosen dims set to 0 in the listed rows only."""
    flag = rows.select(key).withColumn("__f", F.lit(True))
    dl = _dims_lit(dims)
    j = samples.join(flag, key, "left")
    z = F.filter(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")),
                 lambda e: ~(F.coalesce(F.col("__f"), F.lit(False)) & F.array_contains(dl, e["i"])))
    return (j.withColumn("__z", z)
            .withColumn("idx", F.transform("__z", lambda e: e["i"]))
            .withColumn("val", F.transform("__z", lambda e: e["v"])).drop("__f", "__z"))


# P13 ----------------------------------------------------------------------------
def replace_categories(samples: DataFrame, rows: DataFrame, categories: dict[str, list[int]],
                       seed=0, key: str = "row_id") -> DataFrame:
    """For listed rows and each category: unset its active one-hot dim, set a random other one.

    ``categories`` maps category -> its one-hot dims (parameter-sized).  With no
    active dim the choice is over all dims of the category.
    """
    flag = rows.select(key).withColumn("__f", F.lit(True))
    out = samples.join(flag, key, "left")
    for n, (cat, dims) in enumerate(sorted(categories.items())):
        dl = _dims_lit(dims)
        active = F.filter(F.col("idx"), lambda i: F.array_contains(dl, i))
        choices = F.array_except(dl, active)
        pick = F.element_at(choices, (F.pmod(phash(F.concat_ws(":", F.col(key).cast("string"), F.lit(cat)), seed),
                                             F.greatest(F.size(choices), F.lit(1))) + 1).cast("int"))
        keep = F.filter(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")),
                        lambda e: ~F.array_contains(dl, e["i"]))
        add = F.when(F.size(choices) > 0, F.array(F.struct(pick.alias("i"), F.lit(1.0).alias("v")))) \
            .otherwise(F.array().cast("array<struct<i:int,v:double>>"))
        merged = F.array_sort(F.concat(keep, add))
        new_idx = F.transform(merged, lambda e: e["i"])
        new_val = F.transform(merged, lambda e: e["v"])
        hit = F.coalesce(F.col("__f"), F.lit(False))
        out = (out.withColumn("__m", merged)
               .withColumn("idx", F.when(hit, F.transform("__m", lambda e: e["i"])).otherwise(F.col("idx")))
               .withColumn("val", F.when(hit, F.transform("__m", lambda e: e["v"])).otherwise(F.col("val")))
               .drop("__m"))
    return out.drop("__f")


# P14 ----------------------------------------------------------------------------
def flip_bits(samples: DataFrame, rows: DataFrame, dims: Sequence[int], key: str = "row_id") -> DataFrame:
    """Binary features: value -> 1 - value on chosen dims of listed rows (sparse: toggle presence)."""
    flag = rows.select(key).withColumn("__f", F.lit(True))
    dl = _dims_lit(dims)
    j = samples.join(flag, key, "left")
    present = F.filter(F.col("idx"), lambda i: F.array_contains(dl, i))
    turned_on = F.array_except(dl, present)
    keep = F.filter(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")),
                    lambda e: ~F.array_contains(dl, e["i"]))
    merged = F.array_sort(F.concat(keep, F.transform(turned_on, lambda i: F.struct(i.alias("i"), F.lit(1.0).alias("v")))))
    hit = F.coalesce(F.col("__f"), F.lit(False))
    j = j.withColumn("__m", merged)
    return (j.withColumn("idx", F.when(hit, F.transform("__m", lambda e: e["i"])).otherwise(F.col("idx")))
            .withColumn("val", F.when(hit, F.transform("__m", lambda e: e["v"])).otherwise(F.col("val")))
            .drop("__m", "__f"))


def draw_values(samples: DataFrame, dims: Sequence[int], n: int, seed, key: str = "row_id", within: bool = False) -> DataFrame:
    """n seeded rows get, for every dim, values drawn without replacement from that column: from all
    rows, or (``within``) from the chosen rows themselves, which permutes the column among them.

    The k-th chosen row takes the value of the k-th drawn row, both ranked by seeded hash
    (another one per dim): a join on the rank, no window over all rows.
    """
    from ..functions.rand import phash
    from .prefix import global_rank
    from .sampling import choose_rows
    rank = lambda df, s: global_rank(df, [phash(key, s), F.col(key)], name="__rank")
    chosen = rank(choose_rows(samples.select(key), key, n, seed), seed)
    pool = samples.join(chosen.select(key), key, "left_semi") if within else samples
    new = None
    for j in dims:
        value = F.aggregate(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")), F.lit(0.0), lambda acc, e: F.when(e["i"] == j, e["v"]).otherwise(acc))
        drawn = rank(choose_rows(pool.select(key, value.alias("v")), key, n, f"{seed}:{j}"), f"{seed}:{j}")
        part = chosen.join(drawn.select("__rank", "v"), "__rank").select(key, F.struct(F.lit(j).cast("int").alias("i"), "v").alias("e"))
        new = part if new is None else new.unionByName(part)
    new = new.groupBy(key).agg(F.collect_list("e").alias("__new"))
    dl, hit = _dims_lit(dims), F.col("__new").isNotNull()
    kept = F.filter(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")), lambda e: ~F.array_contains(dl, e["i"]))
    out = samples.join(new, key, "left").withColumn("__m", F.array_sort(F.concat(kept, F.filter("__new", lambda e: e["v"] != 0))))
    return (out.withColumn("idx", F.when(hit, F.transform("__m", lambda e: e["i"])).otherwise(F.col("idx")))
            .withColumn("val", F.when(hit, F.transform("__m", lambda e: e["v"])).otherwise(F.col("val"))).select(*samples.columns))


# P16 ----------------------------------------------------------------------------
def rows_delta(samples: DataFrame, new: DataFrame, d: int, key: str = "row_id") -> DataFrame:
    """Change set from new values of listed rows: ``new`` has the key, idx, val and optionally y (null or
    absent: the old label).  ValueError if a key is not in ``samples`` or repeats, a dimension is
    not in 0..d-1, or an array pair differs in length."""
    bad = new.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"),
                  F.count_if(F.coalesce(F.exists("idx", lambda i: (i < 0) | (i >= d)) | (F.size("idx") != F.size("val")), F.lit(True))).alias("shape")).first()
    if bad["shape"] or bad["rows"] != bad["keys"]:
        raise ValueError(f"{bad['shape']} rows do not fit {d} dimensions, {bad['rows'] - bad['keys']} repeat a key or have none")
    label = F.coalesce(F.col("n.y"), F.col("o.y")) if "y" in new.columns else F.col("o.y")
    out = samples.alias("o").join(new.alias("n"), key).select(key, "o.y", "o.idx", "o.val", label.alias("y_delta"), F.col("n.idx").alias("idx_delta"), F.col("n.val").alias("val_delta"))
    missing = new.join(samples.select(key), key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("some of the rows are not in the samples")
    return out


def tuples_delta(old: DataFrame, new: DataFrame, key: str = "row_id") -> DataFrame:
    """Change set from given old and new tuples (key, y, idx, val), whatever the samples hold; a label
    that is null in ``new`` stays."""
    return old.alias("o").join(new.alias("n"), key).select(key, "o.y", "o.idx", "o.val", F.coalesce("n.y", "o.y").alias("y_delta"),
                                                           F.col("n.idx").alias("idx_delta"), F.col("n.val").alias("val_delta"))


# P15 ----------------------------------------------------------------------------
def gather(samples: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    return samples.join(rows.select(key).distinct(), key, "left_semi")


def exclude(samples: DataFrame, rows: DataFrame, key: str = "row_id") -> DataFrame:
    return samples.join(rows.select(key).distinct(), key, "left_anti")


# P18 ----------------------------------------------------------------------------
def misclassified(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return scored.where(F.col(pred) != F.col(label))


# P19 ----------------------------------------------------------------------------
def drop_empty(samples: DataFrame) -> DataFrame:
    return samples.where(F.size("idx") > 0)


# P20 / S9 ------------------------------------------------------------------------
def name_matches(feature: str, needles: Sequence[str]) -> Column:
    """Feature name contains any of the needles (plain substring, case kept)."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.col(feature).contains(n)
    return cond


# P7 -----------------------------------------------------------------------------
def contains_any(text: str, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.col(text).contains(w))


# P10 ----------------------------------------------------------------------------
def redact_words(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """Replace each word (in order) by 'x' * len(word); count of words present per row."""
    out = df.withColumn("hits", F.size(F.filter(F.array(*[F.lit(w) for w in words]),
                                                lambda w: F.col(text).contains(w))))
    t = F.col(text)
    for w in words:
        t = F.replace(t, F.lit(w), F.lit("x" * len(w)))
    return out.withColumn(text, t)


# P1-P3 --------------------------------------------------------------------------
def numeric_columns(df: DataFrame) -> DataFrame:
    """The columns of a numeric type, in their order."""
    return df.select([f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
