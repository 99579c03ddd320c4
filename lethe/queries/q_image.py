"""Softmax head, label-noise and trigger operators on the embeddings stand-in (8 x 8 x 1 view)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import argmax, clip01_arr, one_hot
from ..operators import metrics as me
from ..operators import rewrite as rw
from ..operators import sampling as sa
from ..operators import softmax as sm
from ..sources.standins import IMAGE_DIM, N_CLASSES, image_samples
from . import sqlkit as sk
from .q_numeric import REPORT_SELECT, report_sql
from .registry import register

K, D = N_CLASSES, IMAGE_DIM
ROWS, COLS, CH = 8, 8, 1
W0 = sm.fixed_w(K, D, 0)
V0 = sm.fixed_w(K, D, 5)
FLIP_BUDGET, FLIP_SEED = 40, 42
SHIFT_SEED = 9
WORST_BUDGET = 20
SOURCE, TARGET, N_INJECT, INJECT_SEED = 1, 7, 10, 13
PIXELS = [(7, 7), (6, 6)]
ZERO_N, ZERO_SEED = 10, 21
MIS_BATCH, MIS_SEED = 16, 3


def wsql(k: str, d: str, shift: int = 0) -> str:
    return f"((((7 * {d}) + (3 * {k}) + {shift}) % 11 - 5) / 4.0)"


def probs_sql(where: str = "TRUE", shift: int = 0, name: str = "pr") -> str:
    return f"""
lg_{name} AS (SELECT e.row_id, CAST(c.k AS INTEGER) AS cls, sum(e.value * {wsql('c.k', 'e.dim', shift)}) AS z
         FROM img_entries e, range({K}) c(k) WHERE {where} GROUP BY e.row_id, c.k),
lz_{name} AS (SELECT *, z - max(z) OVER (PARTITION BY row_id) AS zz FROM lg_{name}),
{name} AS (SELECT row_id, cls, exp(zz) / sum(exp(zz)) OVER (PARTITION BY row_id) AS p FROM lz_{name}),
{name}_pred AS (SELECT row_id, cls AS pred, p FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, cls) AS rn FROM {name}) WHERE rn = 1)"""


def _img(spark, sf):
    return image_samples(spark, sf)


# P4 -----------------------------------------------------------------------------
@register("p4_argmax_one_hot", sk.with_(sk.IMG) + """
SELECT row_id, CAST(list_position(x, list_max(x)) - 1 AS INTEGER) AS x_argmax, label AS label_pos FROM img""")
def p4_argmax_one_hot(spark, sf):
    d = _img(spark, sf)
    return d.select("row_id", argmax("x").alias("x_argmax"),
                    (F.array_position(one_hot("label", K), 1.0) - 1).cast("int").alias("label_pos"))


# M4 / T4 ------------------------------------------------------------------------
@register("m4_softmax_predict", sk.with_(sk.IMG, probs_sql()) + """
SELECT row_id, pred, round(p, 6) AS p_max FROM pr_pred""")
def m4_softmax_predict(spark, sf):
    p = sm.predict(_img(spark, sf), W0)
    return p.select("row_id", "pred", F.round(F.array_max("probs"), 6).alias("p_max"))


# M5 -----------------------------------------------------------------------------
@register("m5_softmax_gradient", sk.with_(sk.IMG, probs_sql("e.split = 'train'")) + """
SELECT pr.cls, e.dim, round(sum(e.value * (pr.p - CASE WHEN e.label = pr.cls THEN 1.0 ELSE 0.0 END)), 6) AS g
FROM img_entries e JOIN pr ON pr.row_id = e.row_id GROUP BY pr.cls, e.dim""")
def m5_softmax_gradient(spark, sf):
    g = sm.gradient(_img(spark, sf).where("split = 'train'"), W0)
    return g.select("cls", "dim", F.round("g", 6).alias("g"))


# M6 -----------------------------------------------------------------------------
@register("m6_softmax_hvp", sk.with_(sk.IMG, probs_sql("e.split = 'train'"), f"""
u AS (SELECT e.row_id, CAST(c.k AS INTEGER) AS cls, sum(e.value * {wsql('c.k', 'e.dim', 5)}) AS z
      FROM img_entries e, range({K}) c(k) WHERE e.split = 'train' GROUP BY e.row_id, c.k),
pz AS (SELECT pr.row_id, pr.cls, pr.p, u.z, sum(pr.p * u.z) OVER (PARTITION BY pr.row_id) AS pdotz
       FROM pr JOIN u ON u.row_id = pr.row_id AND u.cls = pr.cls)""") + """
SELECT pz.cls, e.dim, round(sum(e.value * (pz.p * pz.z - pz.p * pz.pdotz)), 6) AS hv
FROM img_entries e JOIN pz ON pz.row_id = e.row_id GROUP BY pz.cls, e.dim""")
def m6_softmax_hvp(spark, sf):
    h = sm.hvp(_img(spark, sf).where("split = 'train'"), W0, V0)
    return h.select("cls", "dim", F.round("hv", 6).alias("hv"))


# A15 (multi-class) -----------------------------------------------------------------
@register("a15_multiclass_report", sk.with_(sk.IMG, probs_sql("e.split = 'test'"), """
scored AS (SELECT i.label, p.pred FROM img i JOIN pr_pred p ON p.row_id = i.row_id)""") + "," +
          report_sql("scored") + " " + REPORT_SELECT)
def a15_multiclass_report(spark, sf):
    p = sm.predict(_img(spark, sf).where("split = 'test'"), W0)
    rep = me.classification_report(p.select(F.col("label").cast("string").alias("label"),
                                            F.col("pred").cast("string").alias("pred")))
    return rep.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# P11 ----------------------------------------------------------------------------
P11_N, P11_SEED, P11_SHIFT = 30, 17, 18


@register("p11_flip_multiclass", sk.with_(sk.IMG, f"""
ch AS (SELECT row_id FROM img ORDER BY {sk.ph('row_id', P11_SEED)}, row_id LIMIT {P11_N})""") + f"""
SELECT i.row_id, CAST(CASE WHEN ch.row_id IS NULL THEN label ELSE (label + {sk.ph('i.row_id', P11_SHIFT)} % {K - 1} + 1) % {K} END AS INTEGER) AS label
FROM img i LEFT JOIN ch ON ch.row_id = i.row_id""")
def p11_flip_multiclass(spark, sf):
    """Chosen rows get one of the other classes, at random."""
    d = _img(spark, sf)
    chosen = sa.choose_rows(d.select("row_id"), "row_id", P11_N, P11_SEED)
    return rw.flip_multiclass(d, chosen, K, P11_SHIFT).select("row_id", "label")


# B1 -----------------------------------------------------------------------------
FLIP_SQL = f"""
flips AS (SELECT row_id, label AS old_label, CAST({K - 1} - label AS INTEGER) AS new_label FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sk.ph('row_id', FLIP_SEED)}, row_id) AS rn
  FROM img WHERE split = 'train') WHERE rn <= {FLIP_BUDGET // K})"""


def _flips(spark, sf):
    return sm.flip_pairs(_img(spark, sf).where("split = 'train'"), FLIP_BUDGET, FLIP_SEED, K)


@register("b1_label_flip_budget", sk.with_(sk.IMG, FLIP_SQL) + " SELECT row_id, old_label, new_label FROM flips")
def b1_label_flip_budget(spark, sf):
    return _flips(spark, sf).select("row_id", "old_label", "new_label")


# U1 (label changes) ------------------------------------------------------------------
@register("u1_label_change_gradient", sk.with_(sk.IMG, FLIP_SQL) + """
, ent AS (SELECT f.old_label, f.new_label, e.dim, e.value FROM flips f JOIN img_entries e ON e.row_id = f.row_id)
SELECT cls, dim, round(sum(g), 6) AS g FROM (
  SELECT old_label AS cls, dim, value AS g FROM ent UNION ALL SELECT new_label, dim, -value FROM ent)
GROUP BY cls, dim""")
def u1_label_change_gradient(spark, sf):
    g = sm.label_change_gradient(_flips(spark, sf), K, D)
    return g.select("cls", "dim", F.round("g", 6).alias("g"))


# B2 -----------------------------------------------------------------------------
@register("b2_class_shift", sk.with_(sk.IMG) + f"""
SELECT label, CAST((label + {sk.ph('label', SHIFT_SEED)} % {K}) % {K} AS INTEGER) AS new_label, count(*) AS n
FROM img WHERE split = 'train' GROUP BY ALL""")
def b2_class_shift(spark, sf):
    d = _img(spark, sf).where("split = 'train'")
    off = sm.class_offsets(K, SHIFT_SEED)
    return d.select("label", sm.shift_labels(d, off, K).alias("new_label")).groupBy("label", "new_label") \
        .agg(F.count(F.lit(1)).alias("n"))


# B3 / T2 ------------------------------------------------------------------------
@register("b3_worst_loss_flip", sk.with_(sk.IMG, probs_sql("e.split = 'train'")) + f"""
, mn AS (SELECT row_id, arg_min(cls, p) AS target, -ln(min(p)) AS loss FROM pr GROUP BY row_id)
SELECT row_id, CAST(target AS INTEGER) AS target, round(loss, 6) AS loss FROM mn
ORDER BY loss DESC, row_id LIMIT {WORST_BUDGET}""")
def b3_worst_loss_flip(spark, sf):
    w = sm.worst_class_loss(_img(spark, sf).where("split = 'train'"), W0)
    top = w.orderBy(F.desc("loss"), "row_id").limit(WORST_BUDGET)
    return top.select("row_id", "target", F.round("loss", 6).alias("loss"))


@register("b3_worst_loss_labels", sk.with_(sk.IMG, probs_sql("e.split = 'train'")) + f"""
, mn AS (SELECT row_id, arg_min(cls, p) AS target, -ln(min(p)) AS loss FROM pr GROUP BY row_id),
top AS (SELECT row_id, target FROM mn ORDER BY loss DESC, row_id LIMIT {WORST_BUDGET})
SELECT i.row_id, i.label AS old_label, CAST(coalesce(t.target, i.label) AS INTEGER) AS label
FROM img i LEFT JOIN top t ON t.row_id = i.row_id WHERE i.split = 'train'""")
def b3_worst_loss_labels(spark, sf):
    """The train rows with the flipped labels written."""
    train = _img(spark, sf).where("split = 'train'")
    top = sm.worst_class_loss(train, W0).orderBy(F.desc("loss"), "row_id").limit(WORST_BUDGET).select("row_id", "target")
    return train.join(top, "row_id", "left").select("row_id", F.col("label").alias("old_label"), F.coalesce("target", "label").alias("label"))


# B5 / B6 ----------------------------------------------------------------------------
VALUE = 0.5
PATTERN = sm.diagonal_cross(ROWS, COLS, CH, (ROWS, COLS))
# The cells of the 3 x 3 corner square on its diagonals.
CORNER_CELLS = {(5, 5), (6, 6), (7, 7), (5, 7), (7, 5)}


def _pattern_sql() -> str:
    return "[" + ", ".join(str(VALUE if divmod(j, COLS) in CORNER_CELLS else 0.0) for j in range(D)) + "]"


@register("b5_b6_cross_trigger", sk.with_(sk.IMG, f"""
sh AS (SELECT row_id, list_transform(x, lambda v: (v + 1) / 2) AS x FROM img),
tr AS (SELECT row_id, x, list_transform(list_zip(x, {_pattern_sql()}), lambda t: greatest(least(t[1] + t[2], 1.0), 0.0)) AS y FROM sh)""") + """
SELECT row_id, round(list_sum(y) - list_sum(x), 6) AS delta,
       CAST(len(list_filter(list_zip(x, y), lambda t: t[1] <> t[2])) AS INTEGER) AS n_changed FROM tr""")
def b5_b6_cross_trigger(spark, sf):
    d = _img(spark, sf).withColumn("x", F.transform("x", lambda v: (v + 1) / 2))
    t = d.withColumn("y", sm.add_pattern("x", PATTERN, VALUE))
    s = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return t.select("row_id", F.round(s(F.col("y")) - s(F.col("x")), 6).alias("delta"),
                    F.size(F.filter(F.arrays_zip(F.col("x").alias("a"), F.col("y").alias("b")),
                                    lambda e: e["a"] != e["b"])).alias("n_changed"))


# B7 / B8 ----------------------------------------------------------------------------
INJ_SQL = f"""
sh AS (SELECT row_id, split, label, list_transform(x, lambda v: (v + 1) / 2) AS x FROM img),
inj AS (SELECT row_id, label, x FROM sh WHERE split = 'train' AND label = {SOURCE}
        ORDER BY {sk.ph('row_id', INJECT_SEED)}, row_id LIMIT {N_INJECT}),
bd AS (SELECT row_id, label AS old_label, {TARGET} AS new_label, x AS orig,
              list_transform(list_zip(x, {_pattern_sql()}), lambda t: greatest(least(t[1] + t[2], 1.0), 0.0)) AS y FROM inj)"""


def _inject(spark, sf):
    d = _img(spark, sf).withColumn("x", F.transform("x", lambda v: (v + 1) / 2))
    elig = d.where((F.col("split") == "train") & (F.col("label") == SOURCE))
    chosen = sa.choose_rows(elig, "row_id", N_INJECT, INJECT_SEED)
    return chosen.select("row_id", F.col("label").alias("old_label"), F.lit(TARGET).alias("new_label"),
                         F.col("x").alias("orig"), sm.add_pattern("x", PATTERN, VALUE).alias("y")), d


@register("b7_backdoor_inject", sk.with_(sk.IMG, INJ_SQL) + """
SELECT row_id, old_label, new_label, round(list_sum(y), 6) AS x_sum FROM bd""")
def b7_backdoor_inject(spark, sf):
    bd, _ = _inject(spark, sf)
    return bd.select("row_id", "old_label", "new_label",
                     F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("x_sum"))


@register("b8_restore_originals", sk.with_(sk.IMG, INJ_SQL) + """
, poisoned AS (SELECT s.row_id, coalesce(b.y, s.x) AS x, coalesce(b.new_label, s.label) AS label FROM sh s
               LEFT JOIN bd b ON b.row_id = s.row_id),
restored AS (SELECT p.row_id, coalesce(b.orig, p.x) AS x, coalesce(b.old_label, p.label) AS label FROM poisoned p
             LEFT JOIN bd b ON b.row_id = p.row_id)
SELECT count(*) AS n_rows,
       CAST(sum(CASE WHEN r.x <> s.x OR r.label <> s.label THEN 1 ELSE 0 END) AS BIGINT) AS n_diff,
       CAST((SELECT count(*) FROM bd) AS BIGINT) AS n_restored
FROM restored r JOIN sh s ON s.row_id = r.row_id""")
def b8_restore_originals(spark, sf):
    bd, d = _inject(spark, sf)
    store = bd.select("row_id", "old_label", "orig", "new_label", "y")
    poisoned = d.join(store, "row_id", "left").select(
        "row_id", F.coalesce("y", "x").alias("x"), F.coalesce("new_label", "label").alias("label"))
    restored = poisoned.join(store.select("row_id", "orig", "old_label"), "row_id", "left").select(
        "row_id", F.coalesce("orig", "x").alias("x"), F.coalesce("old_label", "label").alias("label"))
    cmp = restored.alias("r").join(d.alias("s"), "row_id")
    n_restored = store.count()
    return cmp.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.sum(F.when((F.col("r.x") != F.col("s.x")) | (F.col("r.label") != F.col("s.label")), 1)
                         .otherwise(0)).cast("bigint").alias("n_diff"),
                   F.lit(n_restored).cast("bigint").alias("n_restored"))


# P6 -----------------------------------------------------------------------------
@register("p6_affected_images", sk.with_(sk.IMG) + f"""
SELECT row_id FROM img WHERE {" OR ".join(f"greatest(least(x[{(r * COLS + c) * CH + 1}], 1.0), 0.0) <> 0" for r, c in PIXELS)}""")
def p6_affected_images(spark, sf):
    d = _img(spark, sf).withColumn("x", clip01_arr("x"))
    return d.where(sm.touches_pixels("x", PIXELS, COLS, CH)).select("row_id")


# P9 -----------------------------------------------------------------------------
@register("p9_pixel_removal", sk.with_(sk.IMG, f"""
z AS (SELECT row_id FROM img ORDER BY {sk.ph('row_id', ZERO_SEED)}, row_id LIMIT {ZERO_N})""") + f"""
SELECT row_id, round(CASE WHEN row_id IN (SELECT row_id FROM z)
  THEN list_sum(list_transform(list_zip(x, range(0, {D})), lambda t: CASE WHEN t[2] IN ({", ".join(str((r * COLS + c) * CH) for r, c in PIXELS)}) THEN 0.0 ELSE t[1] END))
  ELSE list_sum(x) END, 6) AS x_sum FROM img""")
def p9_pixel_removal(spark, sf):
    d = _img(spark, sf)
    z = sa.choose_rows(d.select("row_id"), "row_id", ZERO_N, ZERO_SEED).withColumn("__z", F.lit(True))
    j = d.join(z, "row_id", "left")
    x = F.when(F.col("__z"), sm.zero_pixels("x", PIXELS, COLS, CH)).otherwise(F.col("x"))
    return j.select("row_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("x_sum"))


# A21 ----------------------------------------------------------------------------
@register("a21_majority_vote", sk.with_(sk.IMG, probs_sql("e.split <> 'train'", 0, "m0"),
                                        probs_sql("e.split <> 'train'", 1, "m1"),
                                        probs_sql("e.split <> 'train'", 2, "m2"), f"""
votes AS (SELECT row_id, pred FROM m0_pred UNION ALL SELECT row_id, pred FROM m1_pred
          UNION ALL SELECT row_id, pred FROM m2_pred),
cnt AS (SELECT row_id, pred, count(*) AS n FROM votes GROUP BY row_id, pred),
best AS (SELECT row_id, pred, n, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred) AS rn FROM cnt),
den AS (SELECT row_id, sum(exp(n - m)) + ({K} - count(*)) * exp(-m) AS s FROM (
  SELECT row_id, n, max(n) OVER (PARTITION BY row_id) AS m FROM cnt) GROUP BY row_id, m)""") + """
SELECT b.row_id, CAST(b.pred AS INTEGER) AS vote, round(1.0 / d.s, 6) AS p_vote
FROM best b JOIN den d ON d.row_id = b.row_id WHERE b.rn = 1""")
def a21_majority_vote(spark, sf):
    d = _img(spark, sf).where("split <> 'train'")
    preds = None
    for m in range(3):
        p = sm.predict(d, sm.fixed_w(K, D, m)).select("row_id", "pred")
        preds = p if preds is None else preds.unionByName(p)
    v = me.majority_vote(preds, "row_id", "pred", K)
    return v.select("row_id", "vote", F.round(F.element_at("probs", F.col("vote") + 1), 6).alias("p_vote"))


# T3 / P18 -----------------------------------------------------------------------
@register("t3_misclassified_batch", sk.with_(sk.IMG, probs_sql("e.split = 'train'")) + f"""
SELECT i.row_id FROM img i JOIN pr_pred p ON p.row_id = i.row_id WHERE p.pred <> i.label
ORDER BY {sk.ph('i.row_id', MIS_SEED)}, i.row_id LIMIT {MIS_BATCH}""")
def t3_misclassified_batch(spark, sf):
    p = sm.predict(_img(spark, sf).where("split = 'train'"), W0)
    mis = p.where(F.col("pred") != F.col("label")).withColumn("_h", sm.hash_order("row_id", MIS_SEED))
    return mis.orderBy("_h", "row_id").limit(MIS_BATCH).select("row_id")
