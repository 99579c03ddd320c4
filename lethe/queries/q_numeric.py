"""Binary-model aggregates on the lineitem stand-in (row-agnostic: no row key)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import fixed_theta, log_loss, logistic, sparse_dot
from ..operators import features as fe
from ..operators import linear as lin
from ..operators import metrics as me
from ..operators import rewrite as rw
from ..sources.standins import LI_FEATURES, numeric_samples
from ..sources.tables import table
from . import sqlkit as sk
from .registry import register

# Fixed query parameters (mirrored in the SQL below).
D = 4
THETA = fixed_theta(D)            # [-1.25, 0.5, -0.5, 1.25]
LAM = 1.0
V = [1.0, -1.0, 0.5, 2.0]
REMOVE = [2, 3]                   # l_discount, l_tax
TAU = 1e-4

S_SQL = "(-1.25 * x0 + 0.5 * x1 - 0.5 * x2 + 1.25 * x3)"
S_NEW_SQL = "(-1.25 * x0 + 0.5 * x1)"


def _train(spark, sf):
    return numeric_samples(spark, sf).samples.where("split = 'train'")


def _test(spark, sf):
    return numeric_samples(spark, sf).samples.where("split = 'test'")


def report_sql(scored: str) -> str:
    """Classification report over a CTE ``scored(label, pred)`` (labels as text)."""
    return f"""
cm AS (SELECT CAST(label AS VARCHAR) AS label, CAST(pred AS VARCHAR) AS pred, count(*) AS n FROM {scored} GROUP BY ALL),
cls AS (SELECT label AS c FROM cm UNION SELECT pred FROM cm),
per AS (
  SELECT c,
    CAST(coalesce((SELECT sum(n) FROM cm WHERE cm.label = cls.c), 0) AS DOUBLE) AS sup,
    CAST(coalesce((SELECT sum(n) FROM cm WHERE cm.pred = cls.c), 0) AS DOUBLE) AS np,
    CAST(coalesce((SELECT sum(n) FROM cm WHERE cm.label = cls.c AND cm.pred = cls.c), 0) AS DOUBLE) AS tp
  FROM cls),
per2 AS (
  SELECT c, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS precision,
         CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS recall, sup, tp FROM per),
per3 AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM per2),
rep AS (
  SELECT c AS cls, precision, recall, f1, sup AS support FROM per3
  UNION ALL SELECT 'accuracy', sum(tp) / sum(sup), sum(tp) / sum(sup), sum(tp) / sum(sup), sum(sup) FROM per3
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(sup) FROM per3
  UNION ALL SELECT 'weighted avg', sum(precision * sup) / sum(sup), sum(recall * sup) / sum(sup),
                   sum(f1 * sup) / sum(sup), sum(sup) FROM per3)"""


REPORT_SELECT = ("SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, "
                 "round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep")


def report_df(df):
    rep = me.classification_report(df, "label", "pred")
    return rep.select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# A8 -----------------------------------------------------------------------------
@register("a8_sample_loss", sk.with_(sk.LI) + f"""
SELECT round(sum(ln(1 + exp(-y * s))), 4) AS loss, count(*) AS n
FROM (SELECT y, {S_SQL} AS s FROM li_rows WHERE split = 'train')""")
def a8_sample_loss(spark, sf):
    t = lin.with_score(_train(spark, sf), THETA)
    return t.agg(F.round(lin.loss_l(t, THETA), 4).alias("loss"), F.count(F.lit(1)).alias("n"))


# A9 -----------------------------------------------------------------------------
@register("a9_objective", sk.with_(sk.LI) + f"""
SELECT split, round(sum(ln(1 + exp(-y * s))) + 0.5 * {LAM} * {sum(t * t for t in THETA)}, 4) AS objective
FROM (SELECT split, y, {S_SQL} AS s FROM li_rows) GROUP BY split""")
def a9_objective(spark, sf):
    s = lin.with_score(numeric_samples(spark, sf).samples, THETA)
    reg = 0.5 * LAM * float(np.dot(THETA, THETA))
    return s.groupBy("split").agg(F.round(F.sum(log_loss(F.col("y") * F.col("s"))) + F.lit(reg), 4)
                                  .alias("objective"))


# A10 ----------------------------------------------------------------------------
@register("a10_gradient", sk.with_(sk.LI) + f"""
SELECT e.dim, round(sum(-r.y / (1 + exp(r.y * {S_SQL})) * e.value), 4) AS grad
FROM li_entries e JOIN li_rows r ON e.rid = r.rid WHERE r.split = 'train' GROUP BY e.dim""")
def a10_gradient(spark, sf):
    return lin.gradient(_train(spark, sf), THETA).select("dim", F.round("grad", 4).alias("grad"))


# A11 ----------------------------------------------------------------------------
@register("a11_input_gradient", sk.with_(sk.LI) + f"""
SELECT y, {", ".join(f"round(-y / (1 + exp(y * {S_SQL})) * {t}, 6) AS gx{j}" for j, t in enumerate(THETA))}
FROM li_rows WHERE split = 'train'""")
def a11_input_gradient(spark, sf):
    g = lin.input_gradient(_train(spark, sf), THETA)
    return g.select("y", *[F.round(F.element_at("grad_x", j + 1), 6).alias(f"gx{j}") for j in range(D)])


# A12 ----------------------------------------------------------------------------
@register("a12_hessian", sk.with_(sk.LI, f"""
sc AS (SELECT rid, 1 / (1 + exp(-{S_SQL})) AS p FROM li_rows WHERE split = 'train')""") + f"""
SELECT a.dim AS i, b.dim AS j,
       round(sum(sc.p * (1 - sc.p) * a.value * b.value) + CASE WHEN a.dim = b.dim THEN {LAM} ELSE 0.0 END, 4) AS h
FROM li_entries a JOIN li_entries b ON a.rid = b.rid JOIN sc ON sc.rid = a.rid
GROUP BY a.dim, b.dim""")
def a12_hessian(spark, sf):
    return lin.hessian(_train(spark, sf), THETA, D, LAM).select("i", "j", F.round("h", 4).alias("h"))


# A13 ----------------------------------------------------------------------------
@register("a13_hvp", sk.with_(sk.LI, f"""
sc AS (SELECT rid, 1 / (1 + exp(-{S_SQL})) AS p, ({" + ".join(f"{v} * x{j}" for j, v in enumerate(V))}) AS z
       FROM li_rows WHERE split = 'train')""") + f"""
SELECT e.dim, round(sum(sc.p * (1 - sc.p) * sc.z * e.value) + {LAM} * ([{", ".join(map(str, V))}])[e.dim + 1], 4) AS hv
FROM li_entries e JOIN sc ON sc.rid = e.rid GROUP BY e.dim""")
def a13_hvp(spark, sf):
    hv = lin.hvp(_train(spark, sf), THETA, V)
    v = F.array(*[F.lit(x) for x in V])
    return hv.select("dim", F.round(F.col("hv") + F.lit(LAM) * F.element_at(v, F.col("dim") + 1), 4).alias("hv"))


# A4 -----------------------------------------------------------------------------
@register("a4_column_stats", f"""
WITH t AS (SELECT {sk.split_sql('l_orderkey')} AS split, * FROM lineitem),
s AS (
  {" UNION ALL ".join(f"SELECT split, '{c}' AS feature, min({c}) AS mn, max({c}) AS mx, avg({c}) AS mean, stddev_pop({c}) AS std FROM t GROUP BY split" for c in LI_FEATURES)})
SELECT split, feature, round(mn, 6) AS min, round(mx, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std FROM s""")
def a4_column_stats(spark, sf):
    from ..sources.standins import split_col
    li = table(spark, sf, "lineitem").withColumn("split", split_col("l_orderkey"))
    st = fe.column_stats(li, LI_FEATURES, by="split")
    return st.select("split", "feature", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


# A5 -----------------------------------------------------------------------------
@register("a5_row_norms", sk.with_(sk.LI) + """
SELECT split, round(max(sqrt(x0*x0 + x1*x1 + x2*x2 + x3*x3)), 6) AS max_norm,
       round(avg(sqrt(x0*x0 + x1*x1 + x2*x2 + x3*x3)), 6) AS mean_norm,
       CAST(sum(CASE WHEN abs(x0*x0 + x1*x1 + x2*x2 + x3*x3 - 1) < 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_unit
FROM li_rows GROUP BY split""")
def a5_row_norms(spark, sf):
    s = numeric_samples(spark, sf).samples
    sq = F.aggregate("val", F.lit(0.0), lambda a, v: a + v * v)
    return s.groupBy("split").agg(F.round(F.max(F.sqrt(sq)), 6).alias("max_norm"),
                                  F.round(F.avg(F.sqrt(sq)), 6).alias("mean_norm"),
                                  F.sum(F.when(F.abs(sq - 1) < 1e-6, 1).otherwise(0)).cast("bigint").alias("n_unit"))


# P5 (row-agnostic count form) ---------------------------------------------------
@register("p5_affected_count", sk.with_(sk.LI) + """
SELECT split, count(*) AS n_affected FROM li_rows WHERE x2 <> 0 OR x3 <> 0 GROUP BY split""")
def p5_affected_count(spark, sf):
    s = numeric_samples(spark, sf).samples
    return rw.affected_rows(s, REMOVE).groupBy("split").agg(F.count(F.lit(1)).alias("n_affected"))


_G_SQL = sk.with_(sk.LI, f"""
aff AS (SELECT rid, y, {S_SQL} AS s_old, {S_NEW_SQL} AS s_new FROM li_rows
        WHERE split = 'train' AND (x2 <> 0 OR x3 <> 0)),
terms AS (
  SELECT e.dim, -a.y / (1 + exp(a.y * a.s_new)) * e.value AS g
  FROM aff a JOIN li_entries e ON e.rid = a.rid WHERE e.dim IN (0, 1)
  UNION ALL
  SELECT e.dim, a.y / (1 + exp(a.y * a.s_old)) * e.value FROM aff a JOIN li_entries e ON e.rid = a.rid),
gd AS (SELECT dim, sum(g) AS g FROM terms GROUP BY dim)""")


def _g_df(spark, sf):
    return lin.removal_gradient(_train(spark, sf), THETA, REMOVE)


# U1 -----------------------------------------------------------------------------
@register("u1_gradient_diff_numeric", _G_SQL + " SELECT dim, round(g, 4) AS g FROM gd")
def u1_gradient_diff_numeric(spark, sf):
    return _g_df(spark, sf).select("dim", F.round("g", 4).alias("g"))


# U2 -----------------------------------------------------------------------------
@register("u2_first_order_numeric", _G_SQL + f"""
SELECT dim, round({sk.w_sql('dim')} - {TAU} * g, 6) AS theta FROM gd""")
def u2_first_order_numeric(spark, sf):
    g = _g_df(spark, sf)
    from ..functions.scalar import fixed_weight
    return g.select("dim", F.round(fixed_weight("dim") - F.lit(TAU) * F.col("g"), 6).alias("theta"))


def _scored_test(spark, sf, theta):
    t = lin.predict(_test(spark, sf), theta)
    return t.select(F.col("y").cast("string").alias("label"), F.col("pred").cast("string").alias("pred"), "p", "y")


# Flagship ----------------------------------------------------------
def first_order_theta(spark, sf) -> list[float]:
    g = lin.to_vector(_g_df(spark, sf), D, value="g")
    return list(np.asarray(THETA) - TAU * g)


_THETA_NEW_SQL = _G_SQL + ", tn AS (SELECT dim, " + sk.w_sql("dim") + f" - {TAU} * g AS t FROM gd)"


def _scored_new_sql() -> str:
    t = lambda j: f"(SELECT t FROM tn WHERE dim = {j})"
    s = " + ".join(f"{t(j)} * x{j}" for j in range(D))
    return (f", scored AS (SELECT y AS label, CASE WHEN 1 / (1 + exp(-({s}))) >= 0.5 THEN 1.0 ELSE -1.0 END AS pred "
            f"FROM li_rows WHERE split = 'test')")


@register("u11_feature_unlearning_report", _THETA_NEW_SQL + _scored_new_sql() + "," + report_sql("scored") +
          " " + REPORT_SELECT)
def u11_feature_unlearning_report(spark, sf):
    theta = first_order_theta(spark, sf)
    sc = _scored_test(spark, sf, theta)
    return report_df(sc)


# A15 on the fixed model -------------------------------------------------------------
@register("a15_classification_report", sk.with_(sk.LI, f"""
scored AS (SELECT y AS label, CASE WHEN 1 / (1 + exp(-{S_SQL})) >= 0.5 THEN 1.0 ELSE -1.0 END AS pred
           FROM li_rows WHERE split = 'test')""") + "," + report_sql("scored") + " " + REPORT_SELECT)
def a15_classification_report(spark, sf):
    return report_df(_scored_test(spark, sf, THETA))


# A16 ----------------------------------------------------------------------------
@register("a16_confusion_matrix", sk.with_(sk.LI) + f"""
SELECT CAST(y AS VARCHAR) AS label, CASE WHEN 1 / (1 + exp(-{S_SQL})) >= 0.5 THEN '1.0' ELSE '-1.0' END AS pred,
       count(*) AS n FROM li_rows WHERE split = 'test' GROUP BY ALL""")
def a16_confusion_matrix(spark, sf):
    return me.confusion(_scored_test(spark, sf, THETA), "label", "pred")


# W1 / W2 ------------------------------------------------------------------------
AUC_SQL = """
sc AS (SELECT p AS score, sum(CASE WHEN y = 1.0 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN y = 1.0 THEN 0 ELSE 1 END) AS neg FROM scoredp GROUP BY p),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sc),
tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS P, CAST(sum(neg) AS DOUBLE) AS N FROM sc),
terms AS (
  SELECT neg / N * (tp + tp - pos) / P / 2 AS roc,
         CASE WHEN tp - pos < P THEN pos / P *
           ((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END) +
            (CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1.0 END)) / 2
         ELSE 0.0 END AS pr
  FROM cum, tot)
SELECT round(sum(roc), 6) AS roc_auc, round(sum(pr), 6) AS pr_auc FROM terms"""


@register("w1_w2_roc_pr_auc", sk.with_(sk.LI, f"""
scoredp AS (SELECT y, 1 / (1 + exp(-{S_SQL})) AS p FROM li_rows WHERE split = 'test')""") + "," + AUC_SQL)
def w1_w2_roc_pr_auc(spark, sf):
    sc = lin.predict(_test(spark, sf), THETA)
    auc = me.roc_pr_auc(sc, "p", "y", 1.0)
    return auc.select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


# A17 ----------------------------------------------------------------------------
@register("a17_performance", sk.with_(sk.LI, f"""
r AS (SELECT split, y, {S_SQL} AS s, x0, x1, x2, x3 FROM li_rows),
per AS (
  SELECT split, avg(CASE WHEN (CASE WHEN 1 / (1 + exp(-s)) >= 0.5 THEN 1.0 ELSE -1.0 END) = y THEN 1.0 ELSE 0.0 END) AS acc,
         sum(ln(1 + exp(-y * s))) + 0.5 * {LAM} * {sum(t * t for t in THETA)} AS loss,
         {", ".join(f"sum(-y / (1 + exp(y * s)) * x{j}) + {LAM} * {THETA[j]} AS g{j}" for j in range(D))}
  FROM r GROUP BY split)""") + f"""
SELECT split, round(acc, 6) AS accuracy, round(loss, 4) AS loss,
       round({" + ".join(f"g{j} * g{j}" for j in range(D))}, 2) AS gradient_norm FROM per""")
def a17_performance(spark, sf):
    s = numeric_samples(spark, sf).samples
    sc = lin.predict(s, THETA).withColumn("s", sparse_dot("idx", "val", THETA))
    acc = sc.groupBy("split").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("acc"),
                                  F.sum(log_loss(F.col("y") * F.col("s"))).alias("l"))
    reg = 0.5 * LAM * float(np.dot(THETA, THETA))
    f = lin.grad_factor("y", "s")
    g = (sc.select("split", f.alias("f"), F.explode(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v"))).alias("e"))
         .groupBy("split", F.col("e.i").alias("dim")).agg(F.sum(F.col("f") * F.col("e.v")).alias("g")))
    th = F.array(*[F.lit(t) for t in THETA])
    gn = (g.withColumn("gL", F.col("g") + F.lit(LAM) * F.element_at(th, F.col("dim") + 1))
          .groupBy("split").agg(F.sum(F.col("gL") * F.col("gL")).alias("gn")))
    return acc.join(gn, "split").select("split", F.round("acc", 6).alias("accuracy"),
                                        F.round(F.col("l") + F.lit(reg), 4).alias("loss"),
                                        F.round("gn", 2).alias("gradient_norm"))
