"""Softmax head: training, fine-tuning and label-noise unlearning, with unrolled steps as oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import softmax as sm
from ..plans import noise
from ..plans.unlearn import recovery
from . import sqlkit as sk
from .q_image import FLIP_SQL, K, D, W0, _flips, _img, wsql
from .registry import register

EPOCHS, RATE, DECAY = 3, 0.5, 0.01
TUNE_EPOCHS, TUNE_RATE = 2, 0.1
STEPS, BATCH, STEP_TAU, STEP_SEED = 3, 16, 0.02, 5
MIX_RATIO, MIX_SEED = 1.5, 4
CLEAN = 1.0


def logits_sql(name: str, weights: str, rows: str) -> str:
    """CTE name(row_id, cls, p, pred, label, loss part): the model on the rows (row_id, label)."""
    return f"""
{name}_z AS (SELECT e.row_id, w.cls, sum(e.value * w.w) AS z FROM img_entries e JOIN {weights} w ON w.dim = e.dim
  WHERE e.row_id IN (SELECT row_id FROM {rows}) GROUP BY e.row_id, w.cls),
{name}_e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id)) AS ex FROM {name}_z),
{name} AS MATERIALIZED (SELECT l.row_id, l.cls, ex / sum(ex) OVER (PARTITION BY l.row_id) AS p, r.label,
  first_value(l.cls) OVER (PARTITION BY l.row_id ORDER BY ex DESC, l.cls) AS pred FROM {name}_e l JOIN {rows} r ON r.row_id = l.row_id)"""


def steps_sql(start: str, rows: str, rate: float, epochs: int, decay: float, p: str = "") -> str:
    """CTEs w0, m0, w1, m1, ... (names after ``p``): full-batch steps from the SQL value ``start`` of (cls, dim)."""
    out = [f"{p}w0 AS (SELECT CAST(c.k AS INTEGER) AS cls, CAST(j.j AS INTEGER) AS dim, CAST({start} AS DOUBLE) AS w FROM range({K}) c(k), range({D}) j(j))"]
    for k in range(epochs + 1):
        out.append(logits_sql(f"{p}m{k}", f"{p}w{k}", rows))
        if k < epochs:
            out.append(f"""
{p}w{k + 1} AS MATERIALIZED (SELECT w.cls, w.dim, w.w - {rate} * (g.g / (SELECT count(*) FROM {rows}) + {decay} * w.w) AS w FROM {p}w{k} w JOIN (
  SELECT m.cls, e.dim, sum((m.p - CASE WHEN m.label = m.cls THEN 1.0 ELSE 0.0 END) * e.value) AS g
  FROM {p}m{k} m JOIN img_entries e ON e.row_id = m.row_id GROUP BY m.cls, e.dim) g ON g.cls = w.cls AND g.dim = w.dim)""")
    return ",\n".join(out)


# M10 / W6 -----------------------------------------------------------------------
@register("m10_train_head", sk.with_(sk.IMG, "tr AS (SELECT row_id, label FROM img WHERE split = 'train')",
                                     steps_sql("0.0", "tr", RATE, EPOCHS, DECAY),
                                     "ep AS (" + " UNION ALL ".join(f"SELECT {k} AS epoch, -avg(ln(p)) AS loss FROM m{k} WHERE cls = label" for k in range(EPOCHS + 1)) + ")") + """
SELECT CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS loss, loss = min(loss) OVER () AS kept FROM ep""")
def m10_train_head(spark, sf):
    train = _img(spark, sf).where("split = 'train'")
    best, _, log = noise.gradient_steps(train, np.zeros((K, D)), RATE, EPOCHS, DECAY)
    low = min(v for _, v in log)
    return spark.createDataFrame([(e, round(v, 6), v == low) for e, v in log], "epoch int, loss double, kept boolean")


# M9 -----------------------------------------------------------------------------
@register("m9_fine_tune_train", sk.with_(sk.IMG, "tr AS (SELECT row_id, label FROM img WHERE split = 'train')",
                                         steps_sql(wsql("c.k", "j.j"), "tr", TUNE_RATE, TUNE_EPOCHS, 0.0)) + f"""
SELECT cls, dim, round(w, 6) AS w FROM w{TUNE_EPOCHS}""")
def m9_fine_tune_train(spark, sf):
    """Fine-tuning on the whole train split; the table's labels are the corrected ones."""
    _, W, _ = noise.gradient_steps(_img(spark, sf).where("split = 'train'"), W0, TUNE_RATE, TUNE_EPOCHS)
    return spark.createDataFrame([(c, j, round(float(W[c, j]), 6)) for c in range(K) for j in range(D)], "cls int, dim int, w double")


# U9 / U12 / U15 --------------------------------------------------------------------
def _noise_sql(changed: str) -> str:
    out = [f"u0 AS (SELECT CAST(c.k AS INTEGER) AS cls, CAST(j.j AS INTEGER) AS dim, CAST({wsql('c.k', 'j.j')} AS DOUBLE) AS w FROM range({K}) c(k), range({D}) j(j))",
           f"ch AS ({changed})", "va AS (SELECT row_id, label FROM img WHERE split = 'valid')",
           "every AS (SELECT * FROM ch UNION ALL SELECT * FROM va)", logits_sql("q0", "u0", "every")]
    for k in range(STEPS):
        out.append(f"""
b{k} AS MATERIALIZED (SELECT row_id, label, any_value(pred) AS pred FROM q{k} WHERE pred <> label AND row_id IN (SELECT row_id FROM ch)
  GROUP BY row_id, label ORDER BY {sk.ph('row_id', f'{STEP_SEED}:{k}')}, row_id LIMIT {BATCH}),
u{k + 1} AS MATERIALIZED (SELECT u.cls, u.dim, u.w - {STEP_TAU} * coalesce(g.g, 0) AS w FROM u{k} u LEFT JOIN (
  SELECT cls, dim, sum(g) AS g FROM (
    SELECT b.pred AS cls, e.dim, e.value AS g FROM b{k} b JOIN img_entries e ON e.row_id = b.row_id
    UNION ALL SELECT b.label, e.dim, -e.value FROM b{k} b JOIN img_entries e ON e.row_id = b.row_id) GROUP BY cls, dim) g USING (cls, dim))""")
        out.append(logits_sql(f"q{k + 1}", f"u{k + 1}", "every"))
    return ",\n".join(out)


_ONE = lambda k, rows: f"(SELECT DISTINCT row_id, label, pred FROM q{k} WHERE row_id IN (SELECT row_id FROM {rows}))"
_ACC = lambda k, rows: f"(SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FROM {_ONE(k, rows)})"

# U9 / U12 over the whole train split ------------------------------------------------
TRAIN_SQL = sk.with_(sk.IMG, FLIP_SQL, _noise_sql("SELECT row_id, label FROM img WHERE split = 'train'"))


def _unlearn_train(spark, sf):
    img = _img(spark, sf)
    train = img.where("split = 'train'").join(_flips(spark, sf).select("row_id", F.lit(True).alias("flipped")), "row_id", "left")
    valid = img.where("split = 'valid'")
    return valid, noise.unlearn_train_noise(train, valid, W0, STEP_TAU, BATCH, STEPS, STEP_SEED)


@register("u9_label_noise_train", TRAIN_SQL + " " + " UNION ALL ".join(f"""
SELECT {k} AS step, round({_ACC(k + 1, f'b{k}')}, 6) AS batch_accuracy, round({_ACC(k + 1, 'va')}, 6) AS valid_accuracy,
  (SELECT count(*) FROM {_ONE(k + 1, 'ch')} WHERE pred <> label) AS delta_size,
  (SELECT count(*) FROM {_ONE(k + 1, 'ch')} WHERE pred <> label AND row_id NOT IN (SELECT row_id FROM flips)) AS new_errors,
  (SELECT count(*) FROM {_ONE(k + 1, 'flips')} WHERE pred <> label) AS remaining, false AS diverged""" for k in range(STEPS)))
def u9_label_noise_train(spark, sf):
    _, (_, log) = _unlearn_train(spark, sf)
    return spark.createDataFrame([(r["step"], round(r["batch_accuracy"], 6), round(r["valid_accuracy"], 6), r["delta_size"], r["new_errors"],
                                   r["remaining"], r["diverged"]) for r in log],
                                 "step int, batch_accuracy double, valid_accuracy double, delta_size bigint, new_errors bigint, remaining bigint, diverged boolean")


@register("u12_u15_noise_recovery_train", TRAIN_SQL + f"""
SELECT round({_ACC(0, 'va')}, 6) AS before, round({_ACC(STEPS, 'va')}, 6) AS after,
       round(({_ACC(STEPS, 'va')} - {_ACC(0, 'va')}) / ({CLEAN} - {_ACC(0, 'va')}), 6) AS restored""")
def u12_u15_noise_recovery_train(spark, sf):
    """Share of the accuracy that unlearning over the whole train split restores; -1 if it diverged."""
    valid, (_, log) = _unlearn_train(spark, sf)
    before = sm.predict(valid, W0).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    after = log[-1]["valid_accuracy"] if log else before
    restored = -1.0 if log and log[-1]["diverged"] else recovery(before, after, CLEAN)
    return spark.createDataFrame([(round(before, 6), round(after, 6), round(restored, 6))], "before double, after double, restored double")


# R6 -----------------------------------------------------------------------------
@register("r6_mixed_change_set", sk.with_(sk.IMG, FLIP_SQL, "every AS (SELECT row_id, label FROM img WHERE split = 'train')",
                                          f"u0 AS (SELECT CAST(c.k AS INTEGER) AS cls, CAST(j.j AS INTEGER) AS dim, CAST({wsql('c.k', 'j.j')} AS DOUBLE) AS w FROM range({K}) c(k), range({D}) j(j))",
                                          logits_sql("q0", "u0", "every"), f"""
pool AS (SELECT DISTINCT row_id, pred <> label AS priority FROM q0 WHERE row_id NOT IN (SELECT row_id FROM flips)),
pick AS (SELECT row_id, row_number() OVER (ORDER BY priority DESC, {sk.ph('row_id', MIX_SEED)}, row_id) AS rn FROM pool)""") + f"""
SELECT row_id FROM flips UNION ALL SELECT row_id FROM pick WHERE rn <= floor({MIX_RATIO} * (SELECT count(*) FROM flips))""")
def r6_mixed_change_set(spark, sf):
    regular = sm.predict(_img(spark, sf).where("split = 'train'"), W0).select("row_id", (F.col("pred") != F.col("label")).alias("priority"))
    return noise.mix_rows(_flips(spark, sf), regular, MIX_RATIO, MIX_SEED)
