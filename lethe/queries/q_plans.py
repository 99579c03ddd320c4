"""Iterative plans: fits, solvers, second-order and sharded unlearning, certification.

The oracles solve the same problems by other means: on lineitem with the last two features
removed the Hessian is a 2 x 2 block plus lambda I, so SQL solves it by Cramer's rule and
unrolls Newton steps; the tabular plans keep the two numeric features or need no solve.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import fixed_theta
from ..operators import linear as lin
from ..operators import rewrite as rw
from ..operators import sampling as sa
from ..plans import grid as gr
from ..plans import solvers
from ..plans import unlearn as ul
from ..sources.standins import numeric_samples, tabular_samples
from . import sqlkit as sk
from .q_numeric import _G_SQL, D, LAM, REMOVE, S_NEW_SQL, TAU, THETA
from .registry import register

N_SHARDS, SHARD_SEED = 5, 3
DEL_N, DEL_SEED = 100, 7
EPS, DELTA, SIGMA = 0.1, 0.01, 1.0
BATCHES, BATCH_SEED, LR = 4, 0, 0.1
NEWTON_STEPS = 12


# SQL pieces -----------------------------------------------------------------------
def det_sql(m: list[list[str]]) -> str:
    """Determinant of a matrix of SQL expressions by cofactors."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"({m[0][j]}) * ({det_sql([r[:j] + r[j + 1:] for r in m[1:]])})" for j in range(len(m))]
    return "(" + "".join((" - " if j % 2 else " + ") + p for j, p in enumerate(parts)).removeprefix(" + ") + ")"


def cramer_sql(h: list[list[str]], g: list[str], j: int) -> str:
    """Component j of h^-1 g."""
    return f"({det_sql([[*r[:j], g[i], *r[j + 1:]] for i, r in enumerate(h)])} / {det_sql(h)})"


def hessian_sql(name: str, rows: str, score: str, dims: list[int]) -> str:
    """One row h00, h01, ... of the sums over ``rows`` at the given score, lambda on the diagonal."""
    cols = ", ".join(f"sum(p * (1 - p) * x{i} * x{j}) + {LAM if i == j else 0.0} AS h{i}{j}" for i in dims for j in dims if i <= j)
    return f"{name} AS (SELECT {cols} FROM (SELECT *, 1 / (1 + exp(-{score})) AS p FROM {rows}))"


def sym(dims: list[int], prefix: str = "") -> list[list[str]]:
    return [[f"{prefix}h{min(i, j)}{max(i, j)}" for j in dims] for i in dims]


def newton_sql(name: str, rows: str, group: str | None = None) -> str:
    """CTEs name0, name1, ...: Newton steps for two features from zero (per group)."""
    by = f"{group}, " if group else ""
    out = [f"{name}0 AS (SELECT DISTINCT {by}0.0::DOUBLE AS t0, 0.0::DOUBLE AS t1 FROM {rows})"]
    for k in range(NEWTON_STEPS):
        on = f"JOIN {name}{k} n USING ({group})" if group else f"CROSS JOIN {name}{k} n"
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT {by}t0 - {cramer_sql(sym([0, 1]), ['g0', 'g1'], 0)} AS t0, t1 - {cramer_sql(sym([0, 1]), ['g0', 'g1'], 1)} AS t1 FROM (
    SELECT {by}t0, t1, {", ".join(f"sum(-y / (1 + exp(y * s)) * x{i}) + {LAM} * t{i} AS g{i}" for i in (0, 1))},
           {", ".join(f"sum(x{i} * x{j} / (1 + exp(s)) / (1 + exp(-s))) + {LAM if i == j else 0.0} AS h{i}{j}" for i, j in ((0, 0), (0, 1), (1, 1)))}
    FROM (SELECT r.*, t0, t1, t0 * x0 + t1 * x1 AS s FROM {rows} r {on}) GROUP BY {by}t0, t1))""")
    return ",\n".join(out)


LAST = NEWTON_STEPS
_G = [f"(SELECT g FROM gd WHERE dim = {j})" for j in range(D)]
_EDIT = _G_SQL + ", edited AS MATERIALIZED (SELECT y, x0, x1 FROM li_rows WHERE split = 'train'), " + hessian_sql("he", "edited", S_NEW_SQL, [0, 1])
_X = [cramer_sql(sym([0, 1]), _G[:2], j) for j in (0, 1)] + [f"({_G[j]} / {LAM})" for j in REMOVE]
_BY_DIM = lambda exprs, src, what="theta", nd=5: " UNION ALL ".join(
    f"SELECT {j} AS dim, round({e}, {nd}) AS {what} FROM {src}" for j, e in enumerate(exprs))
_SECOND = [f"{THETA[j]} - {_X[j]}" for j in range(D)]
_FIRST = [f"{THETA[j]} - {TAU} * {_G[j]}" for j in range(D)]
_FIT = _EDIT + ", " + newton_sql("n", "edited")


def _theta_df(spark, theta, what="theta", nd=5, **extra):
    """(dim, value, extra...) of a parameter-sized vector."""
    return spark.createDataFrame([(i, round(float(t), nd) + 0.0, *extra.values()) for i, t in enumerate(theta)], ["dim", what, *extra]) \
        .withColumn("dim", F.col("dim").cast("int"))


@contextmanager
def _numeric(spark, sf):
    """(train, edited, delta, G) of the feature removal on lineitem at the fixed theta; the packed train
    rows are built once and kept while the steps read them."""
    with solvers.persisted(numeric_samples(spark, sf, split="train", packs=True).samples) as train:
        delta = rw.removal_delta(train, REMOVE)
        yield train, rw.remove_features(train, REMOVE), delta, ul.change_gradient(delta, THETA, D)


# M1 -----------------------------------------------------------------------------
_FIT_SELECT = _BY_DIM(["t0", "t1", "0.0::DOUBLE", "0.0::DOUBLE"], f"n{LAST}", nd=4)


@register("m1_fit_newton", _FIT + " " + _FIT_SELECT)
def m1_fit_newton(spark, sf):
    with _numeric(spark, sf) as (_, edited, _, _):
        return _theta_df(spark, solvers.fit_newton(edited, D, LAM)[None], nd=4)


@register("m1_fit_lbfgs", _FIT + " " + _FIT_SELECT)
def m1_fit_lbfgs(spark, sf):
    with _numeric(spark, sf) as (_, edited, _, _):
        return _theta_df(spark, solvers.fit_lbfgs(edited, D, LAM), nd=4)


# U3 -----------------------------------------------------------------------------
@register("u3_second_order_numeric", _EDIT + " " + _BY_DIM(_SECOND, "he"))
def u3_second_order_numeric(spark, sf):
    with _numeric(spark, sf) as (_, edited, _, G):
        return _theta_df(spark, ul.second_order(edited, THETA, G, D, LAM))


_T0, _T1 = (f"(SELECT t{j} FROM n{NEWTON_STEPS})" for j in (0, 1))


@register("u3_second_order_tabular", sk.with_(sk.TAB, """
num AS MATERIALIZED (SELECT y, n0 AS x0, n1 AS x1 FROM tab_imp WHERE split = 'train')""", newton_sql("n", "num"), f"""
sc AS (SELECT y, x0, x1, {_T0} * x0 + {_T1} * x1 AS a, {_T0} * x0 AS b FROM num),
g AS (SELECT sum(-y / (1 + exp(y * b)) * x0 + y / (1 + exp(y * a)) * x0) AS g0, sum(y / (1 + exp(y * a)) * x1) AS g1 FROM sc WHERE x1 <> 0),
h AS (SELECT sum(x0 * x0 / (1 + exp(b)) / (1 + exp(-b))) + {LAM} AS h00 FROM sc)""") + f"""
SELECT 0 AS dim, round({_T0} - g0 / h00, 5) AS theta FROM g, h UNION ALL SELECT 1, round({_T1} - g1 / {LAM}, 5) + 0.0 FROM g""")
def u3_second_order_tabular(spark, sf):
    """A fitted model on the two numeric columns loses the second one; the solve is by CG."""
    p = tabular_samples(spark, sf)
    train = rw.remove_features(p.samples, list(range(2, p.d))).where("split = 'train'")
    theta = solvers.fit_newton(train, 2, LAM, tol=1e-11)[None]
    G = ul.change_gradient(rw.removal_delta(train, [1]), theta, 2)
    return _theta_df(spark, ul.second_order(rw.remove_features(train, [1]), theta, G, 2, LAM, solver="cg"))


# U5 -----------------------------------------------------------------------------
_ALL = list(range(D))


@register("u5_influence_methods", _EDIT + ", ho_rows AS (SELECT * FROM li_rows WHERE split = 'train'), " +
          hessian_sql("ho", "ho_rows", "(" + " + ".join(f"{t} * x{j}" for j, t in enumerate(THETA)) + ")", _ALL) + " " +
          " UNION ALL ".join([
              *(f"SELECT {j} AS dim, round({_SECOND[j]}, 5) AS theta, 'newton' AS method FROM he" for j in _ALL),
              *(f"SELECT {j}, round({THETA[j]} - {cramer_sql(sym(_ALL), _G, j)}, 5), 'influence' FROM ho" for j in _ALL),
              *(f"SELECT {j}, {THETA[j]}::DOUBLE, 'lazy'" for j in _ALL)]))
def u5_influence_methods(spark, sf):
    with _numeric(spark, sf) as (train, edited, delta, _):
        found = ul.influence_methods(train, edited, delta, THETA, D, LAM)
    out = None
    for m, th in found.items():
        df = _theta_df(spark, th, method=m)
        out = df if out is None else out.unionByName(df)
    return out


# U6 / U7 ------------------------------------------------------------------------
_SOLVED = _EDIT + " SELECT dim, x, true AS converged FROM (" + _BY_DIM(_X, "he", "x") + ")"


@register("u6_lissa_inverse_hvp", _SOLVED)
def u6_lissa_inverse_hvp(spark, sf):
    with _numeric(spark, sf) as (_, edited, _, G):
        s = ul.inverse_hvp(edited, THETA, G, D, LAM, solver="lissa")
    return _theta_df(spark, s.x, "x", converged=s.converged)


@register("u7_cg_inverse_hvp", _SOLVED)
def u7_cg_inverse_hvp(spark, sf):
    with _numeric(spark, sf) as (_, edited, _, G):
        s = ul.inverse_hvp(edited, THETA, G, D, LAM, solver="cg")
    return _theta_df(spark, s.x, "x", converged=s.converged)


# M11 ----------------------------------------------------------------------------
@register("m11_hessian_eigenvalues", _EDIT + f"""
SELECT 'largest' AS which, round((h00 + h11 + sqrt((h00 - h11) * (h00 - h11) + 4 * h01 * h01)) / 2, 4) AS value, true AS converged FROM he
UNION ALL SELECT 'smallest', {LAM}::DOUBLE, true""")
def m11_hessian_eigenvalues(spark, sf):
    with _numeric(spark, sf) as (_, edited, _, _), solvers.persisted(edited) as data:
        s = solvers.lanczos(lambda v: lin.hvp_vector(data, THETA, list(v), D, LAM), D)
    return spark.createDataFrame([("largest", round(float(s.x[0]), 4), s.converged), ("smallest", round(float(s.x[1]), 4), s.converged)],
                                 "which string, value double, converged boolean")


# U4 -----------------------------------------------------------------------------
def _stepwise_sql(dims: list[int]) -> str:
    """Second-order removal of one feature after the other; theta and the data carry over."""
    th = lambda k, j: f"(SELECT t{j} FROM s{k})"
    out = [f"base AS MATERIALIZED (SELECT * FROM li_rows WHERE split = 'train')", "s0 AS (SELECT " + ", ".join(f"{t}::DOUBLE AS t{j}" for j, t in enumerate(THETA)) + ")"]
    live = list(range(D))
    for k, gone in enumerate(dims):
        rest = [j for j in live if j != gone]
        old = " + ".join(f"{th(k, j)} * x{j}" for j in live)
        new = " + ".join(f"{th(k, j)} * x{j}" for j in rest)
        grads = [f"sum(-y / (1 + exp(y * b)) * x{j}) + sum(y / (1 + exp(y * a)) * x{j}) AS g{j}" for j in rest] + [f"sum(y / (1 + exp(y * a)) * x{gone}) AS g{gone}"]
        out.append(f"g{k} AS MATERIALIZED (SELECT {', '.join(grads)} FROM (SELECT *, {old} AS a, {new} AS b FROM base WHERE x{gone} <> 0))")
        out.append(hessian_sql(f"h{k}", "base", f"({new})", rest).replace(" AS (SELECT", " AS MATERIALIZED (SELECT", 1))
        step = {j: cramer_sql(sym(rest), [f"g{i}" for i in rest], n) for n, j in enumerate(rest)} | {gone: f"g{gone} / {LAM}"}
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT " + ", ".join(f"t{j} - {step.get(j, '0.0')} AS t{j}" for j in range(D)) + f" FROM s{k}, g{k}, h{k})")
        live = rest
    return ",\n".join(out)


@register("u4_stepwise_removal", sk.with_(sk.LI, _stepwise_sql(REMOVE)) + " " + " UNION ALL ".join(
    f"SELECT {j} AS dim, round(t{j}, 5) AS theta, {k} AS step FROM s{k + 1}" for k in range(len(REMOVE)) for j in range(D)))
def u4_stepwise_removal(spark, sf):
    with _numeric(spark, sf) as (train, _, _, _):
        found = ul.stepwise_removal(train, REMOVE, 1, THETA, D, LAM, order=2)
    out = None
    for i, th in enumerate(found):
        df = _theta_df(spark, th, step=i).withColumn("step", F.col("step").cast("int"))
        out = df if out is None else out.unionByName(df)
    return out


# M8 -----------------------------------------------------------------------------
def _fine_tune_sql() -> str:
    out = [f"""chosen AS (SELECT row_id FROM tab_rows WHERE split = 'train' ORDER BY {sk.ph('row_id', DEL_SEED)}, row_id LIMIT {DEL_N})""",
           f"""rows_e AS MATERIALIZED (SELECT r.row_id, CASE WHEN c.row_id IS NULL THEN y ELSE -y END AS y, {sk.ph('r.row_id', BATCH_SEED)} % {BATCHES} AS b
  FROM tab_rows r LEFT JOIN chosen c ON c.row_id = r.row_id WHERE split = 'train')""",
           "ent AS MATERIALIZED (SELECT e.row_id, e.dim, e.value FROM tab_entries e JOIN rows_e USING (row_id))",
           f"w0 AS (SELECT dim, {sk.w_sql('dim')} AS t FROM tab_vocab)"]
    for k in range(BATCHES):
        out.append(f"""w{k + 1} AS MATERIALIZED (
  WITH sc AS (SELECT r.row_id, r.y, coalesce(sum(e.value * w.t), 0) AS s FROM rows_e r LEFT JOIN ent e ON e.row_id = r.row_id
              LEFT JOIN w{k} w ON w.dim = e.dim WHERE r.b = {k} GROUP BY r.row_id, r.y),
  gr AS (SELECT e.dim, sum(-y / (1 + exp(y * s)) * e.value) AS g FROM sc JOIN ent e ON e.row_id = sc.row_id GROUP BY e.dim)
  SELECT w.dim, t - {LR} / (SELECT count(*) FROM sc) * (coalesce(g, 0) + {LAM} * t) AS t FROM w{k} w LEFT JOIN gr ON gr.dim = w.dim)""")
    return ",\n".join(out)


@register("m8_fine_tune", sk.with_(sk.TAB, _fine_tune_sql()) + f" SELECT CAST(dim AS INTEGER) AS dim, round(t, 6) AS theta FROM w{BATCHES}")
def m8_fine_tune(spark, sf):
    """One pass over the whole train set after label flips, as the edited set is what is tuned on."""
    p = tabular_samples(spark, sf)
    train = p.samples.where("split = 'train'")
    flipped = rw.flip_labels(train, sa.choose_rows(train.select("row_id"), "row_id", DEL_N, DEL_SEED))
    th = ul.fine_tune(flipped, fixed_theta(p.d), p.d, LAM, LR, BATCHES, seed=BATCH_SEED)
    return _theta_df(spark, th, nd=6)


# U10 ----------------------------------------------------------------------------
_SHARD_SQL = sk.with_(sk.TAB, f"""
num AS MATERIALIZED (SELECT row_id, split, y, n0 AS x0, n1 AS x1, {sk.ph('row_id', SHARD_SEED)} % {N_SHARDS} AS shard FROM tab_imp),
tr AS MATERIALIZED (SELECT * FROM num WHERE split = 'train'),
gone AS MATERIALIZED (SELECT row_id, shard FROM tr ORDER BY {sk.ph('row_id', DEL_SEED)}, row_id LIMIT 3),
kept AS MATERIALIZED (SELECT * FROM tr WHERE shard IN (SELECT shard FROM gone) AND row_id NOT IN (SELECT row_id FROM gone))""",
                      newton_sql("o", "tr", "shard"), newton_sql("r", "kept", "shard"), f"""
model AS MATERIALIZED (SELECT o.shard, r.shard IS NOT NULL AS retrained, coalesce(r.t0, o.t0) AS t0, coalesce(r.t1, o.t1) AS t1,
                 sqrt(power(coalesce(r.t0, o.t0) - o.t0, 2) + power(coalesce(r.t1, o.t1) - o.t1, 2)) AS change
          FROM o{LAST} o LEFT JOIN r{LAST} r ON r.shard = o.shard),
vote AS (SELECT n.row_id, n.y, CASE WHEN sum(CASE WHEN t0 * x0 + t1 * x1 >= 0 THEN 1 ELSE -1 END) > 0 THEN 1.0 ELSE -1.0 END AS v
         FROM num n CROSS JOIN model WHERE n.split = 'test' GROUP BY n.row_id, n.y)""")


@register("u10_sharded_unlearning", _SHARD_SQL + """
SELECT CAST(shard AS INTEGER) AS shard, retrained, round(change, 5) AS theta_change,
       (SELECT round(avg(CASE WHEN v = y THEN 1.0 ELSE 0.0 END), 6) FROM vote) AS vote_accuracy FROM model""")
def u10_sharded_unlearning(spark, sf):
    """Shards of the tabular rows on their two numeric features."""
    p = tabular_samples(spark, sf)
    with solvers.persisted(rw.remove_features(p.samples, list(range(2, p.d)))) as rows:
        train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
        deleted = sa.choose_rows(train.select("row_id"), "row_id", 3, DEL_SEED)
        models = ul.sharded_fit(train, N_SHARDS, 2, LAM, SHARD_SEED)
        new, hit = ul.sharded_unlearn(train, deleted, models, N_SHARDS, 2, LAM, SHARD_SEED)
        acc = ul.ensemble_predict(test, new, keep=("y",)).agg(F.avg((F.col("vote") == F.col("y")).cast("double"))).collect()[0][0]
    out = [(g, g in hit, round(float(np.linalg.norm(new[g] - models[g])), 5), round(acc, 6)) for g in sorted(new)]
    return spark.createDataFrame(out, "shard int, retrained boolean, theta_change double, vote_accuracy double")


# C1-C4 / Q1 -----------------------------------------------------------------------
METHODS = ("original", "first_order", "second_order", "retrain")


@contextmanager
def _methods(spark, sf):
    with _numeric(spark, sf) as (_, rows, _, G), solvers.persisted(rows) as edited:
        yield edited, {"original": np.asarray(THETA), "first_order": ul.first_order(THETA, G, TAU),
                       "second_order": ul.second_order(edited, THETA, G, D, LAM), "retrain": solvers.fit_newton(edited, D, LAM)[None]}


def _methods_sql() -> str:
    rows = {"original": [f"{t}::DOUBLE" for t in THETA], "first_order": _FIRST, "second_order": _SECOND, "retrain": ["t0", "t1", "0.0", "0.0"]}
    return "meth AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT '{m}' AS method, " + ", ".join(f"{e} AS m{j}" for j, e in enumerate(v)) + f" FROM he, n{LAST}" for m, v in rows.items()) + ")"


@register("c1_c4_certification", _FIT + ", " + _methods_sql() + f""",
res AS (SELECT method, sqrt({" + ".join(["power(g0, 2)", "power(g1, 2)", f"power({LAM} * m2, 2)", f"power({LAM} * m3, 2)"])}) AS r FROM (
  SELECT method, m2, m3, sum(-y / (1 + exp(y * (m0 * x0 + m1 * x1))) * x0) + {LAM} * m0 AS g0,
         sum(-y / (1 + exp(y * (m0 * x0 + m1 * x1))) * x1) + {LAM} * m1 AS g1 FROM edited CROSS JOIN meth GROUP BY method, m0, m1, m2, m3))
SELECT method, round(r, 4) AS residual, round(r * sqrt(2 * ln(1.5 / {DELTA})) / {EPS}, 3) AS certified_sigma,
       round({SIGMA} * {EPS} / sqrt(2 * ln(1.5 / {DELTA})), 6) AS beta, r <= {SIGMA} * {EPS} / sqrt(2 * ln(1.5 / {DELTA})) AS certified FROM res""")
def c1_c4_certification(spark, sf):
    with _methods(spark, sf) as (edited, methods):
        theta = np.stack(list(methods.values()))
        residual = np.linalg.norm(gr.grid_stats(edited, gr.grid(theta)).grad + LAM * theta, axis=1)    # all methods in one job
    rows = []
    for m, res in zip(methods, residual.tolist()):
        c = ul.certification(res, EPS, DELTA, SIGMA)
        rows.append((m, round(res, 4), round(c["certified_sigma"], 3), round(c["beta"], 6), bool(c["certified"])))
    return spark.createDataFrame(rows, "method string, residual double, certified_sigma double, beta double, certified boolean")


@register("q1_fidelity", _FIT + ", " + _methods_sql() + """
SELECT method, round(avg(CASE WHEN (CASE WHEN m0 * x0 + m1 * x1 >= 0 THEN 1.0 ELSE -1.0 END) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM li_rows CROSS JOIN meth WHERE split = 'test' GROUP BY method""")
def q1_fidelity(spark, sf):
    """Accuracy of every method on test after removing the chosen features, in one pass."""
    with _methods(spark, sf) as (_, methods):
        test = rw.remove_features(numeric_samples(spark, sf, split="test").samples, REMOVE)
    for m, th in methods.items():
        test = lin.with_score(test, list(th), m)
    acc = [F.avg((F.when(F.col(m) >= 0, 1.0).otherwise(-1.0) == F.col("y")).cast("double")).alias(m) for m in methods]
    row = test.agg(*acc).collect()[0]
    return spark.createDataFrame([(m, round(float(row[m]), 6)) for m in methods], "method string, accuracy double")
