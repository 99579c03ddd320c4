"""Second-order unlearning, stochastic inverse products and mini-batch tuning of the softmax head, with
every solver step unrolled in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linear as lin
from ..operators import softmax as sm
from ..plans import head
from ..plans.unlearn import recovery
from ..sources.standins import numeric_samples
from . import sqlkit as sk
from .q_image import FLIP_SQL, K, D, W0, _flips, _img, wsql
from .q_noise import BATCH, CLEAN, logits_sql
from .q_numeric import D as LD, LAM, REMOVE, S_NEW_SQL, THETA, _G_SQL
from .q_plans import _numeric
from .registry import register

DAMPING = 40.0
CG_STEPS = 14
SOLVE_SEED = 5
STEPS, RATIO, MIX_TAU, MIX_SEED = 2, 0.5, 0.02, 17
L_BATCHES, L_ROUNDS, L_STEPS, L_SCALE, L_DAMP, L_SEED = 2, 2, 3, 400.0, 0.1, 23
B_BATCHES, B_ROUNDS, B_STEPS, B_SCALE, B_DAMP, B_SEED = 3, 2, 5, 20000.0, 0.01, 29
TUNE_BATCHES, TUNE_EPOCHS, TUNE_RATE, TUNE_SEED = 3, 2, 0.1, 37
DRAWS, DRAW_SEED = 50, 41

START = f"u0 AS (SELECT CAST(c.k AS INTEGER) AS cls, CAST(j.j AS INTEGER) AS dim, CAST({wsql('c.k', 'j.j')} AS DOUBLE) AS w FROM range({K}) c(k), range({D}) j(j))"
TR = "tr AS MATERIALIZED (SELECT row_id, label FROM img WHERE split = 'train'), va AS (SELECT row_id, label FROM img WHERE split = 'valid'), every AS (SELECT * FROM tr UNION ALL SELECT * FROM va)"


def product_sql(name: str, vec: str, col: str, probs: str, rows: str, by: str = "1.0") -> str:
    """CTE name(cls, dim, hv): the Hessian over ``rows`` times column ``col`` of ``vec``, times ``by``."""
    return f"""
{name}_z AS (SELECT e.row_id, v.cls, sum(e.value * v.{col}) AS z FROM img_entries e JOIN {vec} v ON v.dim = e.dim
  WHERE e.row_id IN (SELECT row_id FROM {rows}) GROUP BY e.row_id, v.cls),
{name}_q AS (SELECT z.row_id, z.cls, p * z - p * sum(p * z) OVER (PARTITION BY z.row_id) AS q FROM {name}_z z JOIN {probs} m ON m.row_id = z.row_id AND m.cls = z.cls),
{name} AS MATERIALIZED (SELECT q.cls, e.dim, {by} * sum(q.q * e.value) AS hv FROM {name}_q q JOIN img_entries e ON e.row_id = q.row_id GROUP BY q.cls, e.dim)"""


def cg_sql(name: str, g: str, probs: str, damping: float) -> str:
    """CTEs name0, name1, ... (cls, dim, x, r, p): conjugate gradients for (H + damping I) x = g over the train rows."""
    out = [f"{name}0 AS MATERIALIZED (SELECT cls, dim, 0.0::DOUBLE AS x, g AS r, g AS p FROM {g})"]
    for k in range(CG_STEPS):
        out.append(product_sql(f"{name}h{k}", f"{name}{k}", "p", probs, "tr"))
        out.append(f"""
{name}a{k} AS MATERIALIZED (SELECT v.*, coalesce(hv, 0) + {damping} * p AS ap FROM {name}{k} v LEFT JOIN {name}h{k} USING (cls, dim)),
{name}b{k} AS MATERIALIZED (SELECT cls, dim, p, r AS old, x + a * p AS x, r - a * ap AS r FROM {name}a{k}, (
  SELECT CASE WHEN sum(p * ap) > 0 THEN sum(r * r) / sum(p * ap) ELSE 0 END AS a FROM {name}a{k})),
{name}{k + 1} AS MATERIALIZED (SELECT cls, dim, x, r, r + b * p AS p FROM {name}b{k}, (
  SELECT CASE WHEN sum(old * old) > 0 THEN sum(r * r) / sum(old * old) ELSE 0 END AS b FROM {name}b{k}))""")
    return ",\n".join(out)


def change_sql(name: str, delta: str) -> str:
    """CTE name(cls, dim, g) for all of W: the gradient of moving ``delta`` (row_id, old, new)."""
    return f"""{name} AS MATERIALIZED (SELECT u.cls, u.dim, coalesce(sum(s.g), 0) AS g FROM u0 u LEFT JOIN (
  SELECT b.old AS cls, e.dim, e.value AS g FROM {delta} b JOIN img_entries e ON e.row_id = b.row_id
  UNION ALL SELECT b.new, e.dim, -e.value FROM {delta} b JOIN img_entries e ON e.row_id = b.row_id) s USING (cls, dim) GROUP BY u.cls, u.dim)"""


def picked_sql(name: str, q: str, step: int, seed) -> str:
    return f"""{name} AS MATERIALIZED (SELECT row_id, any_value(pred) AS old, label AS new FROM {q} WHERE pred <> label AND row_id IN (SELECT row_id FROM tr)
  GROUP BY row_id, label ORDER BY {sk.ph('row_id', f'{seed}:{step}')}, row_id LIMIT {BATCH})"""


def _second_sql(steps: int) -> str:
    out = [START, TR, logits_sql("q0", "u0", "every")]
    for k in range(steps):
        out += [picked_sql(f"b{k}", f"q{k}", k, SOLVE_SEED), change_sql(f"g{k}", f"b{k}"), cg_sql(f"c{k}_", f"g{k}", f"q{k}", DAMPING),
                f"u{k + 1} AS MATERIALIZED (SELECT u.cls, u.dim, u.w - c.x AS w FROM u{k} u JOIN c{k}_{CG_STEPS} c USING (cls, dim))", logits_sql(f"q{k + 1}", f"u{k + 1}", "every")]
    return ",\n".join(out)


_ONE = lambda k, rows: f"(SELECT DISTINCT row_id, label, pred FROM q{k} WHERE row_id IN (SELECT row_id FROM {rows}))"
_ACC = lambda k, rows: f"(SELECT avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) FROM {_ONE(k, rows)})"
_SIZES = lambda k: f"""(SELECT count(*) FROM {_ONE(k, 'tr')} WHERE pred <> label) AS delta_size,
  (SELECT count(*) FROM {_ONE(k, 'tr')} WHERE pred <> label AND row_id NOT IN (SELECT row_id FROM flips)) AS new_errors,
  (SELECT count(*) FROM {_ONE(k, 'flips')} WHERE pred <> label) AS remaining"""  # noqa: E731
LOG = "step int, valid_accuracy double, delta_size bigint, new_errors bigint, remaining bigint, diverged boolean"


def _rows(spark, sf):
    img = _img(spark, sf)
    old = _flips(spark, sf).select("row_id", F.col("new_label").alias("old_label"))
    return img.where("split = 'train'").join(old, "row_id", "left"), img.where("split = 'valid'")


def _weights(spark, W, nd=6):
    return spark.createDataFrame([(c, j, round(float(W[c, j]), nd)) for c in range(K) for j in range(D)], "cls int, dim int, w double")


def _log(spark, log):
    return spark.createDataFrame([(r["step"], round(r["valid_accuracy"], 6), r["delta_size"], r["new_errors"], r["remaining"], r["diverged"]) for r in log], LOG)


# U9 / U12, order 2 ----------------------------------------------------------------------
@register("u9_second_order_step", sk.with_(sk.IMG, FLIP_SQL, _second_sql(1)) + " SELECT cls, dim, round(w, 6) AS w FROM u1")
def u9_second_order_step(spark, sf):
    """W after one second-order step on the rows that the model gets wrong."""
    train, valid = _rows(spark, sf)
    return _weights(spark, head.unlearn_steps(train, valid, W0, 1, SOLVE_SEED, second=head.Second(DAMPING), batch=BATCH)[0])


@register("u12_u15_second_order_recovery", sk.with_(sk.IMG, FLIP_SQL, _second_sql(STEPS)) + f"""
SELECT round({_ACC(0, 'va')}, 6) AS before, round({_ACC(STEPS, 'va')}, 6) AS after,
       round(({_ACC(STEPS, 'va')} - {_ACC(0, 'va')}) / ({CLEAN} - {_ACC(0, 'va')}), 6) AS restored, {_SIZES(STEPS)}""")
def u12_u15_second_order_recovery(spark, sf):
    """What second-order unlearning over the whole train split restores; -1 if it diverged."""
    train, valid = _rows(spark, sf)
    _, log = head.unlearn_steps(train, valid, W0, STEPS, SOLVE_SEED, second=head.Second(DAMPING), batch=BATCH)
    before = sm.predict(valid, W0).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
    last = log[-1] if log else {"valid_accuracy": before, "diverged": False, "delta_size": 0, "new_errors": 0, "remaining": 0}
    restored = -1.0 if last["diverged"] else recovery(before, last["valid_accuracy"], CLEAN)
    return spark.createDataFrame([(round(before, 6), round(last["valid_accuracy"], 6), round(restored, 6), last["delta_size"], last["new_errors"], last["remaining"])],
                                 "before double, after double, restored double, delta_size bigint, new_errors bigint, remaining bigint")


# R8 -------------------------------------------------------------------------------------
def draws_sql(name: str, pool: str, n: str, seed) -> str:
    """CTE name: the rows of ``pool`` (row_id, ...) drawn n times with replacement."""
    return f"""{name} AS MATERIALIZED (SELECT d.draw, p.* FROM (SELECT i AS draw, floor({sk.unif('i', seed)} * (SELECT count(*) FROM {pool})) + 1 AS rn FROM range(CAST({n} AS BIGINT)) r(i)) d
  JOIN (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM {pool}) p USING (rn))"""


@register("r8_draws_with_replacement", sk.with_(sk.IMG, TR, START, logits_sql("q0", "u0", "every"),
                                                "wrong AS MATERIALIZED (SELECT DISTINCT row_id, label, pred FROM q0 WHERE pred <> label AND row_id IN (SELECT row_id FROM tr))",
                                                draws_sql("dr", "wrong", str(DRAWS), DRAW_SEED)) + " SELECT draw, row_id, pred FROM dr")
def r8_draws_with_replacement(spark, sf):
    wrong = sm.predict(_img(spark, sf).where("split = 'train'"), W0).where("pred <> label").select("row_id", "pred")
    return head.draw_rows(wrong, DRAWS, DRAW_SEED).select("draw", "row_id", "pred")


def _mixed_sql() -> str:
    out = [START, TR, logits_sql("q0", "u0", "every")]
    for k in range(STEPS):
        out += [f"w{k} AS MATERIALIZED (SELECT DISTINCT row_id, label, pred FROM q{k} WHERE pred <> label AND row_id IN (SELECT row_id FROM tr) AND row_id NOT IN (SELECT row_id FROM flips))",
                draws_sql(f"x{k}", f"w{k}", f"floor({RATIO} * (SELECT count(*) FROM flips))", f"{MIX_SEED}:{k}"),
                f"b{k} AS (SELECT row_id, new_label AS old, old_label AS new FROM flips UNION ALL SELECT row_id, pred, label FROM x{k})",
                change_sql(f"g{k}", f"b{k}"), f"u{k + 1} AS MATERIALIZED (SELECT cls, dim, w - {MIX_TAU} * g AS w FROM u{k} JOIN g{k} USING (cls, dim))",
                logits_sql(f"q{k + 1}", f"u{k + 1}", "every")]
    return ",\n".join(out)


@register("u9_mixed_draws", sk.with_(sk.IMG, FLIP_SQL, _mixed_sql()) + " " + " UNION ALL ".join(
    f"SELECT {k} AS step, round({_ACC(k + 1, 'va')}, 6) AS valid_accuracy, {_SIZES(k + 1)}, false AS diverged" for k in range(STEPS)))
def u9_mixed_draws(spark, sf):
    """The change set with draws (with replacement) from the other wrong rows, order 1."""
    train, valid = _rows(spark, sf)
    return _log(spark, head.unlearn_steps(train, valid, W0, STEPS, MIX_SEED, tau=MIX_TAU, ratio=RATIO)[1])


# U6 -------------------------------------------------------------------------------------
def _lissa_sql() -> str:
    n = "(SELECT count(*) FROM tr)"
    out = [START, TR, logits_sql("q0", "u0", "tr"), picked_sql("b0", "q0", 0, SOLVE_SEED), change_sql("g0", "b0")]
    for r in range(L_ROUNDS):
        out += [f"t{r}_{b} AS MATERIALIZED (SELECT row_id FROM tr WHERE {sk.ph('row_id', f'{L_SEED}:{r}')} % {L_BATCHES} = {b})" for b in range(L_BATCHES)]
        out.append(f"l{r}_0 AS (SELECT cls, dim, g AS v, g AS u FROM g0)")
        for i in range(L_STEPS):
            part = f"t{r}_{i % L_BATCHES}"
            out += [product_sql(f"h{r}_{i}", f"l{r}_{i}", "u", "q0", part, f"({n} / (SELECT count(*) FROM {part}))"),
                    f"l{r}_{i + 1} AS MATERIALIZED (SELECT cls, dim, v, v + (1 - {L_DAMP}) * u - coalesce(hv, 0) / {L_SCALE} AS u FROM l{r}_{i} LEFT JOIN h{r}_{i} USING (cls, dim))"]
    return ",\n".join(out)


@register("u6_head_lissa", sk.with_(sk.IMG, _lissa_sql()) + f"""
SELECT cls, dim, round(avg(u / {L_SCALE}), 9) AS x FROM ({" UNION ALL ".join(f"SELECT * FROM l{r}_{L_STEPS}" for r in range(L_ROUNDS))}) GROUP BY cls, dim""")
def u6_head_lissa(spark, sf):
    """Stochastic inverse product on the softmax head: batches, rounds averaged."""
    train = _img(spark, sf).where("split = 'train'")
    wrong = head.hash_cut(sm.predict(train, W0).where("pred <> label"), "row_id", f"{SOLVE_SEED}:0", BATCH)
    G = sm.as_matrix(sm.label_change_gradient(wrong.select(F.col("pred").alias("old_label"), F.col("label").alias("new_label"), "x"), K, D), K, D)
    got = head.head_lissa(train, W0, G, L_BATCHES, L_SCALE, L_DAMP, L_STEPS, L_ROUNDS, seed=L_SEED)
    return spark.createDataFrame([(c, j, round(float(got.x[c, j]), 9)) for c in range(K) for j in range(D)], "cls int, dim int, x double")


def _binary_lissa_sql() -> str:
    cols = lambda f, sep=", ": sep.join(f.format(j=j) for j in range(LD))
    out = [f"ed AS MATERIALIZED (SELECT row_id, x0, x1, 0.0 AS x2, 0.0 AS x3, 1 / (1 + exp(-{S_NEW_SQL})) AS p FROM li_rows WHERE split = 'train')"]
    for r in range(B_ROUNDS):
        out.append(f"l{r}_0 AS (SELECT " + cols("coalesce((SELECT g FROM gd WHERE dim = {j}), 0) AS v{j}") + ", " + cols("coalesce((SELECT g FROM gd WHERE dim = {j}), 0) AS u{j}") + ")")
        for i in range(B_STEPS):
            mine = f"{sk.ph('row_id', f'{B_SEED}:{r}')} % {B_BATCHES} = {i % B_BATCHES}"
            out.append(f"l{r}_{i + 1} AS MATERIALIZED (SELECT " + cols("v{j}") + ", " + cols(f"v{{j}} + (1 - {B_DAMP}) * u{{j}} - ((SELECT count(*) FROM ed) * h{{j}} / n + {LAM} * u{{j}}) / {B_SCALE} AS u{{j}}") + f"""
  FROM l{r}_{i}, (SELECT count(*) AS n, {cols('sum(p * (1 - p) * z * x{j}) AS h{j}')} FROM (SELECT ed.*, {cols('x{j} * u{j}', ' + ')} AS z FROM ed, l{r}_{i} WHERE {mine})))""")
    return ",\n".join(out)


@register("u6_lissa_batches", _G_SQL + ", " + _binary_lissa_sql() + " " + " UNION ALL ".join(
    f"SELECT {j} AS dim, round(avg(u{j}) / {B_SCALE}, 9) AS x, false AS diverged FROM ({' UNION ALL '.join(f'SELECT * FROM l{r}_{B_STEPS}' for r in range(B_ROUNDS))})" for j in range(LD)))
def u6_lissa_batches(spark, sf):
    """Stochastic inverse product on the linear model; every step is a product over one batch."""
    with _numeric(spark, sf) as (_, _, _, G):
        edited = lin_edited(spark, sf)
    with head.persisted(head.dealt(edited, B_BATCHES, B_ROUNDS, B_SEED).select("y", "idx", "val", "deal")) as rows:
        part = head.batch_products(rows, B_BATCHES, lambda some, u: lin.hvp_vector(some, THETA, list(u), LD))
        got = head.lissa_rounds(lambda r, b, u: part(r, b, u) + LAM * u, G, B_BATCHES, B_SCALE, B_DAMP, B_STEPS, B_ROUNDS)
    return spark.createDataFrame([(j, round(float(v), 9), got.diverged) for j, v in enumerate(got.x)], "dim int, x double, diverged boolean")


def lin_edited(spark, sf):
    from ..operators.rewrite import remove_features
    return remove_features(numeric_samples(spark, sf, keyed=True).samples.where("split = 'train'"), REMOVE)


# M9 -------------------------------------------------------------------------------------
def _sgd_sql() -> str:
    out, at = [START, TR], 0
    for epoch in range(TUNE_EPOCHS):
        for b in range(TUNE_BATCHES):
            out += [f"s{at} AS MATERIALIZED (SELECT row_id, label FROM tr WHERE {sk.ph('row_id', f'{TUNE_SEED}:{epoch}')} % {TUNE_BATCHES} = {b})", logits_sql(f"m{at}", f"u{at}", f"s{at}"), f"""
u{at + 1} AS MATERIALIZED (SELECT u.cls, u.dim, u.w - {TUNE_RATE} * coalesce(g.g, 0) / greatest((SELECT count(*) FROM s{at}), 1) AS w FROM u{at} u LEFT JOIN (
  SELECT m.cls, e.dim, sum((m.p - CASE WHEN m.label = m.cls THEN 1.0 ELSE 0.0 END) * e.value) AS g FROM m{at} m JOIN img_entries e ON e.row_id = m.row_id
  GROUP BY m.cls, e.dim) g USING (cls, dim))"""]
            at += 1
    return ",\n".join(out)


@register("m9_sgd_batches", sk.with_(sk.IMG, _sgd_sql()) + f" SELECT cls, dim, round(w, 6) AS w FROM u{TUNE_EPOCHS * TUNE_BATCHES}")
def m9_sgd_batches(spark, sf):
    """Mini-batch fine-tuning on the corrected labels of the whole train split."""
    return _weights(spark, head.sgd(_img(spark, sf).where("split = 'train'"), W0, TUNE_RATE, TUNE_BATCHES, TUNE_EPOCHS, TUNE_SEED))


# Q8 -------------------------------------------------------------------------------------
P_BUDGETS, P_SEEDS, P_RATE, P_EPOCHS, P_TAU = (40, 120), (42, 43), 2.0, 2, 0.004
CELLS = [(b, s) for b in P_BUDGETS for s in P_SEEDS]


def _poison_sql() -> str:
    out = [TR, "pf AS MATERIALIZED (" + " UNION ALL ".join(f"""
SELECT {c} AS cell, row_id, {K - 1} - label AS label FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {sk.ph('row_id', s)}, row_id) AS rn FROM tr) WHERE rn <= {b // K}"""
           for c, (b, s) in enumerate(CELLS)) + ")",
           f"""pl AS MATERIALIZED (SELECT c.cell, t.row_id, coalesce(f.label, t.label) AS label, t.label AS truth FROM tr t CROSS JOIN range({len(CELLS) + 1}) c(cell)
  LEFT JOIN pf f ON f.cell = c.cell AND f.row_id = t.row_id)""",
           f"pw0 AS (SELECT CAST(c.cell AS INTEGER) AS cell, CAST(k.k AS INTEGER) AS cls, CAST(j.j AS INTEGER) AS dim, 0.0::DOUBLE AS w FROM range({len(CELLS) + 1}) c(cell), range({K}) k(k), range({D}) j(j))"]

    def prob(name, w, rows):
        return f"""{name} AS MATERIALIZED (SELECT cell, row_id, cls, ex / sum(ex) OVER (PARTITION BY cell, row_id) AS p, first_value(cls) OVER (PARTITION BY cell, row_id ORDER BY ex DESC, cls) AS pred FROM (
  SELECT w.cell, e.row_id, w.cls, exp(sum(e.value * w.w)) AS ex FROM img_entries e JOIN {w} w ON w.dim = e.dim WHERE e.row_id IN (SELECT row_id FROM {rows}) GROUP BY w.cell, e.row_id, w.cls))"""

    def grad(name, m, label):
        return f"""{name} AS MATERIALIZED (SELECT m.cell, m.cls, e.dim, sum((m.p - CASE WHEN l.{label} = m.cls THEN 1.0 ELSE 0.0 END) * e.value) AS g
  FROM {m} m JOIN pl l ON l.cell = m.cell AND l.row_id = m.row_id JOIN img_entries e ON e.row_id = m.row_id GROUP BY m.cell, m.cls, e.dim)"""
    n = "(SELECT count(*) FROM tr)"
    for e in range(P_EPOCHS):
        out += [prob(f"pm{e}", f"pw{e}", "tr"), grad(f"pg{e}", f"pm{e}", "label"),
                f"pw{e + 1} AS MATERIALIZED (SELECT cell, cls, dim, w - {P_RATE} * g / {n} AS w FROM pw{e} JOIN pg{e} USING (cell, cls, dim))"]
    W = f"pw{P_EPOCHS}"
    out += [prob("pe", W, "tr"), grad("gt", "pe", "truth"), grad("gw", "pe", "label"),
            f"wf AS MATERIALIZED (SELECT cell, cls, dim, w - {P_TAU} * (gt.g - gw.g) AS w FROM {W} JOIN gt USING (cell, cls, dim) JOIN gw USING (cell, cls, dim))",
            f"wt AS MATERIALIZED (SELECT cell, cls, dim, w - {P_RATE} * gt.g / {n} AS w FROM {W} JOIN gt USING (cell, cls, dim))"]
    for name, w in (("a0", W), ("a1", "wf"), ("a2", "wt")):
        out += [prob(f"{name}p", w, "va"), f"{name} AS MATERIALIZED (SELECT cell, avg((pred = label)::INT) AS acc FROM (SELECT DISTINCT cell, row_id, pred FROM {name}p) JOIN va USING (row_id) GROUP BY cell)"]
    return ",\n".join(out)


@register("q8_poison_grid", sk.with_(sk.IMG, _poison_sql(), "cell(cell, budget, seed) AS (VALUES " + ", ".join(f"({c}, {b}, {s})" for c, (b, s) in enumerate(CELLS)) + ")") +
          " UNION ALL ".join(f"""
SELECT budget, seed, '{m}' AS method, round(b.acc, 6) AS before, round(a.acc, 6) AS after,
  round(CASE WHEN c.acc = b.acc THEN 0.0 ELSE (a.acc - b.acc) / (c.acc - b.acc) END, 6) + 0.0 AS restored
FROM cell JOIN a0 b USING (cell) JOIN {t} a USING (cell), (SELECT acc FROM a0 WHERE cell = {len(CELLS)}) c""" for m, t in (("first-order", "a1"), ("fine-tuning", "a2"))))
def q8_poison_grid(spark, sf):
    """Budget x seed x method: what each repair restores of the accuracy that label flips cost."""
    img = _img(spark, sf)
    train, flips = img.where("split = 'train'"), None
    for c, (budget, seed) in enumerate(CELLS):
        part = sm.flip_pairs(train, budget, seed, K).select(F.lit(c).alias("cell"), "row_id", "new_label")
        flips = part if flips is None else flips.unionByName(part)
    got = head.poison_grid(train, img.where("split = 'valid'"), flips, len(CELLS), K, D, P_RATE, P_EPOCHS, P_TAU)
    return spark.createDataFrame([(*CELLS[c], m, round(b, 6), round(a, 6), round(r, 6) + 0.0) for c, m, b, a, r in got],
                                 "budget int, seed int, method string, before double, after double, restored double")
