"""Comparisons of unlearning methods over many removals, and grids of perturbed fits.

The oracles keep one row per model (combination, shard, grid cell) and unroll the same Newton,
fine-tuning and stepwise updates over the four lineitem features, each 4 x 4 system by
Cramer's rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.rand import gaussian, gaussian_vector
from ..operators import sampling as sa
from ..plans import grid as gr
from ..plans.unlearn import certification
from ..sources.standins import numeric_samples, text_samples
from . import sqlkit as sk
from .q_numeric import D, LAM
from .q_plans import cramer_sql, sym
from .registry import register

DIMS = list(range(D))
# The label of these comparisons: a large charge, which the features tell.
POSITIVE = "l_extendedprice * (1 - l_discount) * (1 + l_tax) > 45000"
LI = sk.li(POSITIVE)
N_COMBOS, COMBO_LEN, COMBO_SEED = 4, 2, 5
HOW = gr.Removal(lam=LAM, tau=1e-4, lr=0.1, batches=4, stepsize=1, shards=5, shard_seed=3, batch_seed=1)
SIGMA, NOISE_SEED = 0.5, 9
LAMBDAS, SIGMAS, REPS, GRID_SEED = (1.0, 50.0), (0.0, 20.0), (1, 3), 21
EPS, DELTA, CERT_REPS, CERT_SEED = 100.0, 1.0, 3, 31
STEPS = 12
METHODS = gr.METHODS
LOSS_METHODS = ("DP", "Occlusion", "1st-Order", "2nd-Order", "Retrained", "Finetuning")
RESIDUAL_METHODS = ("DP", "Finetuning", "1st-Order", "2nd-Order")


# SQL pieces -------------------------------------------------------------------------------
def cols(fmt: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(j=j) for j in DIMS)


T = cols("t{j}")
S = cols("t{j} * x{j}", " + ")
SLOPE = ", ".join(f"sum(-y / (1 + exp(y * s)) * x{j}) AS d{j}" for j in DIMS)
CURVE = ", ".join(f"sum(x{i} * x{j} / (1 + exp(s)) / (1 + exp(-s))) AS c{i}{j}" for i in DIMS for j in DIMS if i <= j)
FULL = ", ".join(f"c{i}{j} + {'lam' if i == j else '0.0'} AS h{i}{j}" for i in DIMS for j in DIMS if i <= j)


def step_sql(g: list[str]) -> str:
    """t - H^-1 g, from columns t, h and g."""
    return ", ".join(f"t{j} - {cramer_sql(sym(DIMS), g, j)} AS t{j}" for j in DIMS)


def newton_sql(name: str, rows: str, cells: str, on: list[str]) -> str:
    """CTEs name0, name1, ...: Newton steps from zero for every row of ``cells`` (its keys, lam, b0..)
    over the rows with the same ``on`` columns; cells without rows drop out."""
    out = [f"{name}0 AS (SELECT *, {cols('0.0::DOUBLE AS t{j}')} FROM {cells})"]
    join = f"JOIN {rows} r USING ({', '.join(on)})" if on else f"CROSS JOIN {rows} r"
    for k in range(STEPS):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT * EXCLUDE ({T}, {cols('g{j}')}, {", ".join(f"h{i}{j}" for i in DIMS for j in DIMS if i <= j)}), {step_sql(['g0', 'g1', 'g2', 'g3'])} FROM (
    SELECT n.*, {cols('d{j} + lam * t{j} + b{j} AS g{j}')}, {FULL} FROM {name}{k} n JOIN (
      SELECT cell, {SLOPE}, {CURVE} FROM (SELECT n.cell, y, {cols('x{j}')}, {S} AS s FROM {name}{k} n {join}) GROUP BY cell) USING (cell)))""")
    return ",\n".join(out)


def noise_sql(sigma: str, seed: str, key: str = "{j}") -> str:
    return cols(f"{sigma} * {sk.normal(key, seed)} AS b{{j}}")


def removal_sql(sigma: float) -> str:
    """Rows, combinations, the original fit and every method's parameters, one row a combination."""
    b = noise_sql(f"{sigma}::DOUBLE", NOISE_SEED, "'{j}'")
    pick = f"cast(combo_id AS varchar) || ':' || cast(dim AS varchar)"
    parts = [LI, f"""
combos AS MATERIALIZED (SELECT combo_id, dim, row_number() OVER (PARTITION BY combo_id ORDER BY dim) AS place FROM (
  SELECT combo_id, dim, row_number() OVER (PARTITION BY combo_id ORDER BY {sk.ph(pick, COMBO_SEED)}, {pick}) AS rn
  FROM range({N_COMBOS}) c(combo_id), range({D}) d(dim)) WHERE rn <= {COMBO_LEN}),
flags AS MATERIALIZED (SELECT combo_id, {cols('CAST(count(*) FILTER (dim = {j}) = 0 AS INT) AS k{j}')},
  {cols('CAST(count(*) FILTER (dim = {j} AND place = 1) = 0 AS INT) AS one{j}')} FROM combos GROUP BY combo_id),
base AS MATERIALIZED (SELECT *, {sk.ph('row_id', HOW.shard_seed)} % {HOW.shards} AS shard, {sk.ph('row_id', HOW.batch_seed)} % {HOW.batches} AS batch FROM li_rows),
edit AS MATERIALIZED (SELECT combo_id, split, y, shard, batch, {cols('x{j} * k{j} AS x{j}')}, {cols('(k{j} = 0 AND x{j} <> 0)', ' OR ')} AS touched
  FROM base CROSS JOIN flags),
tr AS MATERIALIZED (SELECT * FROM edit WHERE split = 'train'),
tro AS MATERIALIZED (SELECT * FROM base WHERE split = 'train'),
calm AS MATERIALIZED (SELECT * FROM tr WHERE NOT touched),
noise AS MATERIALIZED (SELECT {LAM}::DOUBLE AS lam, {b}),
cell_o AS (SELECT 0 AS cell, * FROM noise),
cell_r AS (SELECT combo_id AS cell, combo_id, noise.* FROM flags, noise),
cell_s AS (SELECT combo_id * {HOW.shards} + shard AS cell, combo_id, shard, noise.* FROM flags, range({HOW.shards}) s(shard), noise)""",
             newton_sql("o", "tro", "cell_o", []), newton_sql("re", "tr", "cell_r", ["combo_id"]), newton_sql("sh", "calm", "cell_s", ["combo_id", "shard"])]

    def change(name: str, start: str, before: str, after: str) -> list[str]:
        """G (d0..) of the columns whose flag ``before`` is 1 and ``after`` 0, per combination."""
        new, old = cols(f"t{{j}} * x{{j}} * {after}", " + "), cols(f"t{{j}} * x{{j}} * {before}", " + ")
        fnew, fold = "(-y / (1 + exp(y * a)))", "(-y / (1 + exp(y * o)))"
        return [f"""{name}_g AS MATERIALIZED (SELECT combo_id, {cols(f'sum({fnew} * x{{j}} * {after} - {fold} * x{{j}} * {before}) AS d{{j}}')}
  FROM (SELECT *, {new} AS a, {old} AS o FROM tro CROSS JOIN (SELECT * FROM {start} JOIN flags USING (combo_id))
        WHERE {cols(f'(x{{j}} <> 0 AND {before} = 1 AND {after} = 0)', ' OR ')}) GROUP BY combo_id)"""]

    def first(name: str, start: str) -> str:
        return f"{name} AS MATERIALIZED (SELECT combo_id, {cols(f't{{j}} - {HOW.tau} * coalesce(d{{j}}, 0) AS t{{j}}')} FROM {start} LEFT JOIN {name}_g USING (combo_id))"

    def second(name: str, start: str, after: str) -> str:
        masked = CURVE
        for j in DIMS:
            masked = masked.replace(f"x{j}", f"(x{j} * {after.format(j=j)})")
        s = cols(f"t{{j}} * x{{j}} * {after}", " + ")
        return f"""{name} AS MATERIALIZED (SELECT combo_id, {step_sql(['d0', 'd1', 'd2', 'd3'])} FROM (
  SELECT combo_id, {T}, {cols('d{j}')}, {FULL} FROM {start} JOIN {name}_g USING (combo_id) JOIN (
    SELECT combo_id, {LAM}::DOUBLE AS lam, {masked} FROM (SELECT *, {s} AS s FROM tro CROSS JOIN (SELECT * FROM {start} JOIN flags USING (combo_id)))
    GROUP BY combo_id) USING (combo_id)))"""
    parts += [f"st AS MATERIALIZED (SELECT combo_id, {T} FROM flags, o{STEPS})",
              *change("fi", "st", "1", "k{j}"), first("fi", "st"), *change("se", "st", "1", "k{j}"), second("se", "st", "k{j}"),
              *change("f1", "st", "1", "one{j}"), first("f1", "st"), *change("f2", "f1", "one{j}", "k{j}"), first("f2", "f1"),
              *change("s1", "st", "1", "one{j}"), second("s1", "st", "one{j}"), *change("s2", "s1", "one{j}", "k{j}"), second("s2", "s1", "k{j}"), f"ft0 AS (SELECT * FROM st)"]
    for k in range(HOW.batches):
        parts.append(f"""ft{k + 1} AS MATERIALIZED (SELECT combo_id, {cols(f't{{j}} - {HOW.lr} / n * (d{{j}} + {LAM} * t{{j}} + b{{j}}) AS t{{j}}')} FROM ft{k} JOIN (
  SELECT combo_id, count(*) AS n, {SLOPE} FROM (SELECT *, {S} AS s FROM tr JOIN ft{k} USING (combo_id) WHERE batch = {k}) GROUP BY combo_id) USING (combo_id), noise)""")
    where = {"DP": "st", "Occlusion": "st", "1st-Order": "fi", "2nd-Order": "se", "Retrained": f"re{STEPS}", "Finetuning": f"ft{HOW.batches}",
             "1st-Order-It": "f2", "2nd-Order-It": "s2"}
    parts.append("meth AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT combo_id, '{m}' AS method, {T} FROM {t}" for m, t in where.items()) + ")")
    return sk.with_(*parts)


def _removal(spark, sf):
    """(train, test, combinations of removed columns); the rows are packed, train with shards and batches."""
    deals = {"shard": (HOW.shards, HOW.shard_seed), "batch": (HOW.batches, HOW.batch_seed)}
    side = lambda split, deals=None: numeric_samples(spark, sf, keyed=True, positive=POSITIVE, split=split, packs=True, deals=deals).samples
    combos = sa.feature_combinations(spark, D, N_COMBOS, COMBO_LEN, COMBO_SEED).collect()
    return side("train", deals), side("test"), [sorted(r["dim"] for r in combos if r["combo_id"] == k) for k in range(N_COMBOS)]


# R9 ---------------------------------------------------------------------------------------
@register("r9_gaussian_noise", sk.with_(sk.text()) + f" SELECT dim, feature, round({SIGMA} * {sk.normal('dim', NOISE_SEED)}, 9) AS b FROM txt_vocab")
def r9_gaussian_noise(spark, sf):
    """The perturbation vector b of the text model: one normal draw a term."""
    vocab = text_samples(spark, sf).vocab
    return vocab.select("dim", "feature", F.round(F.lit(SIGMA) * gaussian("dim", NOISE_SEED), 9).alias("b"))


# Q1 ---------------------------------------------------------------------------------------
@register("q1_fidelity_grid", removal_sql(0.0) + f""",
vote AS (SELECT combo_id, CASE WHEN coalesce(v, 0) > 0 THEN 1.0 ELSE -1.0 END = y AS hit FROM (
  SELECT e.rid, e.combo_id, any_value(e.y) AS y, sum(CASE WHEN n.cell IS NULL THEN 0 WHEN {cols('n.t{j} * e.x{j}', ' + ')} >= 0 THEN 1 ELSE -1 END) AS v
  FROM (SELECT row_number() OVER () AS rid, * FROM edit WHERE split = 'test') e LEFT JOIN sh{STEPS} n ON n.combo_id = e.combo_id GROUP BY e.rid, e.combo_id)),
acc AS (SELECT method, combo_id, avg(CASE WHEN (CASE WHEN {S} >= 0 THEN 1.0 ELSE -1.0 END) = y THEN 1.0 ELSE 0.0 END) AS a
        FROM edit JOIN meth USING (combo_id) WHERE split = 'test' GROUP BY method, combo_id
        UNION ALL SELECT 'Sharding', combo_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FROM vote GROUP BY combo_id)
SELECT method, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM acc GROUP BY method""")
def q1_fidelity_grid(spark, sf):
    """Accuracy of all nine methods over combinations of removed features: mean and spread."""
    train, test, combos = _removal(spark, sf)
    acc = gr.accuracies(test, *gr.unlearned(train, combos, D, HOW))
    return spark.createDataFrame([(m, round(float(acc[m].mean()), 6), round(float(acc[m].std()), 6)) for m in METHODS], "method string, mean double, std double")


# A22 / Q2 ---------------------------------------------------------------------------------
_LOSS = f"sum(ln(1 + exp(-abs(y * s))) + greatest(-y * s, 0))"


@register("q2_loss_differences", removal_sql(SIGMA) + f""",
orig AS (SELECT {_LOSS} AS l FROM (SELECT y, {S} AS s FROM base, o{STEPS} WHERE split = 'test')),
losses AS (SELECT method, combo_id, {_LOSS} AS l FROM (SELECT method, combo_id, y, {S} AS s FROM edit JOIN meth USING (combo_id) WHERE split = 'test') GROUP BY method, combo_id)
SELECT CAST(combo_id AS INTEGER) AS combo_id, method,
       round(losses.l + {cols(f'{0.5 * LAM} * m.t{{j}} * m.t{{j}} + b{{j}} * m.t{{j}}', ' + ')}
             - orig.l - ({cols(f'{0.5 * LAM} * o.t{{j}} * o.t{{j}} + o.b{{j}} * o.t{{j}}', ' + ')}), 3) AS loss_difference
FROM losses JOIN meth m USING (combo_id, method), orig, (SELECT {T}, {cols('b{j}')} FROM o{STEPS}) o
WHERE method IN {LOSS_METHODS}""".replace("+ b", "+ o.b"))
def q2_loss_differences(spark, sf):
    """Loss on the edited test rows less the original model's loss on the untouched ones, per
    combination and method, with the noise term b."""
    train, test, combos = _removal(spark, sf)
    b = np.array(gaussian_vector(D, NOISE_SEED, SIGMA))
    keep, thetas = gr.unlearned(train, combos, D, HOW, b, LOSS_METHODS)
    loss = {m: gr.objectives(s, thetas[m], LAM, b) for m, s in gr.scores(test, keep, thetas).items()}
    start = thetas["DP"][:1]
    original = gr.objectives(gr.grid_stats(test, gr.grid(start)), start, LAM, b)[0]
    return spark.createDataFrame([(k, m, round(float(loss[m][k] - original), 3)) for m in LOSS_METHODS for k in range(len(combos))],
                                 "combo_id int, method string, loss_difference double")


# C3 / Q4 ----------------------------------------------------------------------------------
def _cells() -> list[tuple[float, float, int]]:
    return [(lam, sigma, rep) for lam in LAMBDAS for sigma, n in zip(SIGMAS, REPS) for rep in range(n)]


def _cells_sql() -> str:
    return " UNION ALL ".join(f"SELECT {k} AS cell, {sigma}::DOUBLE AS sigma, {lam}::DOUBLE AS lam, " + noise_sql(f"{sigma}::DOUBLE", f"{GRID_SEED}:{rep}", "'{j}'")
                              for k, (lam, sigma, rep) in enumerate(_cells()))


@register("c3_noise_grid", sk.with_(LI, f"tr AS MATERIALIZED (SELECT * FROM li_rows WHERE split = 'train'), cells AS MATERIALIZED ({_cells_sql()})",
                                    newton_sql("n", "tr", "cells", [])) + f"""
SELECT lam AS lambda, sigma, round(avg(a), 6) AS accuracy, count(*) AS repetitions FROM (
  SELECT cell, lam, sigma, avg(CASE WHEN (CASE WHEN {S} >= 0 THEN 1.0 ELSE -1.0 END) = y THEN 1.0 ELSE 0.0 END) AS a
  FROM li_rows CROSS JOIN n{STEPS} WHERE split = 'test' GROUP BY cell, lam, sigma) GROUP BY lam, sigma""")
def c3_noise_grid(spark, sf):
    """Accuracy under noise for a grid of lambda and sigma, averaged over repetitions: all cells
    are fitted in the same jobs."""
    rows = numeric_samples(spark, sf, positive=POSITIVE).samples
    cells = _cells()
    b = np.array([gaussian_vector(D, f"{GRID_SEED}:{rep}", sigma) for _, sigma, rep in cells])
    theta = gr.fit_grid(rows.where("split = 'train'"), gr.grid(np.zeros((len(cells), D))), [c[0] for c in cells], b)
    acc = gr.grid_stats(rows.where("split = 'test'"), gr.grid(theta)).accuracy
    out = [(lam, sigma, round(float(np.mean([a for a, c in zip(acc, cells) if c[:2] == (lam, sigma)])), 6), n) for lam in LAMBDAS for sigma, n in zip(SIGMAS, REPS)]
    return spark.createDataFrame(out, "lambda double, sigma double, accuracy double, repetitions bigint")


# Q3 ---------------------------------------------------------------------------------------
_CERT = f"sqrt(2 * ln(1.5 / {DELTA})) / {EPS}"


@register("q3_gradient_residuals", removal_sql(0.0) + f""",
res AS (SELECT method, combo_id, sqrt({cols(f'power(d{{j}} + {LAM} * t{{j}}, 2)', ' + ')}) AS r FROM (
  SELECT method, combo_id, {T}, {SLOPE} FROM (SELECT *, {S} AS s FROM tr JOIN meth USING (combo_id) WHERE method IN {RESIDUAL_METHODS}) GROUP BY method, combo_id, {T})),
mean AS MATERIALIZED (SELECT method, avg(r) AS r, stddev_pop(r) AS sd, avg(r) * {_CERT} AS sigma FROM res GROUP BY method),
ccell AS MATERIALIZED (SELECT row_number() OVER () AS cell, method, sigma, rep, {LAM}::DOUBLE AS lam, """ +
          cols(f"sigma * CASE rep " + " ".join(f"WHEN {r} THEN {sk.normal(chr(39) + '{j}' + chr(39), f'{CERT_SEED}:{r}')}" for r in range(CERT_REPS)) + " END AS b{j}") + f"""
  FROM mean, range({CERT_REPS}) q(rep)),
""" + newton_sql("cn", "tro", "ccell", []) + f""",
conf AS (SELECT method, cell, count(*) AS n, count(*) FILTER (y > 0) AS p, count(*) FILTER (s >= 0) AS q, count(*) FILTER (y > 0 AND s >= 0) AS tp
         FROM (SELECT method, cell, y, {S} AS s FROM base CROSS JOIN cn{STEPS} WHERE split = 'test') GROUP BY method, cell),
fone AS (SELECT *, 2 * tp / greatest(p + q, 1) AS up, 2 * (n - p - q + tp) / greatest(2 * n - p - q, 1) AS dn FROM conf)
SELECT method, round(any_value(m.r), 4) AS mean_residual, round(any_value(m.sd), 4) AS std_residual, round(any_value(m.sigma), 5) AS sigma,
       round(avg((n - p - q + 2 * tp) / n), 6) AS accuracy, round(avg((up + dn) / 2), 6) AS macro_f1, round(avg((up * p + dn * (n - p)) / n), 6) AS weighted_f1
FROM fone JOIN mean m USING (method) GROUP BY method""")
def q3_gradient_residuals(spark, sf):
    """Mean gradient residual of each method over the combinations, the noise that certifies it, and
    what a model trained under that noise is worth (averaged over repetitions)."""
    train, test, combos = _removal(spark, sf)
    with gr.persisted(train):
        keep, thetas = gr.unlearned(train, combos, D, HOW, methods=RESIDUAL_METHODS)
        res = gr.residuals(train, keep, thetas, LAM)
        sigma = {m: certification(float(res[m].mean()), EPS, DELTA, 0.0)["certified_sigma"] for m in RESIDUAL_METHODS}
        b = np.array([gaussian_vector(D, f"{CERT_SEED}:{r}", sigma[m]) for m in RESIDUAL_METHODS for r in range(CERT_REPS)])
        fits = gr.fit_grid(train, gr.grid(np.zeros(b.shape)), LAM, b)
    st = gr.grid_stats(test, gr.grid(fits))
    macro, weighted = st.f1()
    mean = lambda v, k: round(float(v[k * CERT_REPS:(k + 1) * CERT_REPS].mean()), 6)
    return spark.createDataFrame([(m, round(float(res[m].mean()), 4), round(float(res[m].std()), 4), round(sigma[m], 5), mean(st.accuracy, k), mean(macro, k),
                                   mean(weighted, k)) for k, m in enumerate(RESIDUAL_METHODS)],
                                 "method string, mean_residual double, std_residual double, sigma double, accuracy double, macro_f1 double, weighted_f1 double")


# U14 --------------------------------------------------------------------------------------
BLOCKS = [[0], [1], [2], [3], [0, 1], [2, 3]]
_B = [[int(j in c) for j in DIMS] for c in BLOCKS]


@register("u14_block_influence", sk.with_(LI, f"""
tro AS MATERIALIZED (SELECT * FROM li_rows WHERE split = 'train'),
noise AS (SELECT {LAM}::DOUBLE AS lam, {cols('0.0::DOUBLE AS b{j}')}), cell_o AS (SELECT 0 AS cell, * FROM noise)""", newton_sql("o", "tro", "cell_o", []), f"""
one AS MATERIALIZED (SELECT y AS y0, {cols('x{j} AS z{j}')} FROM li_rows WHERE split = 'test' ORDER BY row_id, {cols('x{j}')}, y LIMIT 1),
adj AS MATERIALIZED (SELECT {", ".join(f"{cramer_sql(sym(DIMS), ['g0', 'g1', 'g2', 'g3'], j)} AS s{j}" for j in DIMS)} FROM (
  SELECT {cols(f"-y0 / (1 + exp(y0 * ({cols('t{j} * z{j}', ' + ').replace('{', '{{').replace('}', '}}')}))) * z{{j}} AS g{{j}}")}, {FULL}
  FROM (SELECT {CURVE} FROM (SELECT *, {S} AS s FROM tro, o{STEPS})), one, o{STEPS})),
sc AS (SELECT *, {S} AS s, {cols('s{j} * x{j}', ' + ')} AS a FROM tro, adj, o{STEPS})""") + " " + " UNION ALL ".join(f"""
SELECT {k} AS block, round(sum(-y / (1 + exp(y * (s - ({" + ".join(f"t{j} * x{j}" for j in c)})))) * (a - ({" + ".join(f"s{j} * x{j}" for j in c)})) + y / (1 + exp(y * s)) * a)
  / (SELECT count(*) FROM tro), 12) AS influence FROM sc WHERE {" OR ".join(f"x{j} <> 0" for j in c)}""" for k, c in enumerate(BLOCKS)))
def u14_block_influence(spark, sf):
    """Influence of feature blocks on one test prediction (the first by order key and features)."""
    rows = numeric_samples(spark, sf, keyed=True, positive=POSITIVE).samples
    train = rows.where("split = 'train'")
    dense = rows.where("split = 'test'").select("row_id", "y", F.map_from_arrays("idx", "val").alias("m"))
    dense = dense.select("row_id", "y", *[F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(0.0)).alias(f"x{j}") for j in DIMS])
    one = dense.orderBy("row_id", *[f"x{j}" for j in DIMS], "y").limit(1).collect()[0]
    theta = gr.fit_grid(train, gr.grid(np.zeros(D)), LAM)[0]
    got = gr.block_influence(train, theta, (one["y"], np.array([one[f"x{j}"] for j in DIMS])), BLOCKS, LAM)
    return spark.createDataFrame([(k, round(float(v), 12)) for k, v in enumerate(got)], "block int, influence double")


# Q6 / Q7 / A20 ------------------------------------------------------------------------------
@register("q6_gradient_counts", removal_sql(0.0).split(",\ntr AS MATERIALIZED")[0] + """
SELECT '1st-Order' AS method, round(avg(n), 4) AS gradients FROM (SELECT combo_id, count(*) FILTER (touched) AS n FROM edit WHERE split = 'train' GROUP BY combo_id)
UNION ALL SELECT 'Finetuning', round(count(*)::DOUBLE, 4) FROM base WHERE split = 'train'""")
def q6_gradient_counts(spark, sf):
    """Row gradients of the methods that take a fixed number of them, averaged over the combinations."""
    train, _, combos = _removal(spark, sf)
    keep = np.ones((len(combos), D), bool)
    for k, c in enumerate(combos):
        keep[k, c] = False
    return spark.createDataFrame([("1st-Order", round(float(gr.touched_rows(train, keep).mean()), 4)), ("Finetuning", round(float(gr.grid_stats(train, gr.grid(np.zeros(D))).n[0]), 4))],
                                 "method string, gradients double")


@register("q6_q7_run_times")
def q6_q7_run_times(spark, sf):
    """Wall time and row gradients of every method over the combinations; times differ from run to run."""
    train, _, combos = _removal(spark, sf)
    return spark.createDataFrame([(m, round(s, 3), round(g, 1)) for m, s, g in gr.run_times(train, combos, D, HOW)], "method string, seconds double, gradients double")
