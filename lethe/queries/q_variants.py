"""Variants of rewriting, injection, change sets and updates; data summary; stored artefacts."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import metrics as me
from ..operators import rewrite as rw
from ..operators import sampling as sa
from ..operators import triggers as tg
from ..operators.blocks import map_packs
from ..operators.summary import data_summary
from ..plans import grid as gr
from ..plans import noise
from ..plans import unlearn as ul
from ..session import checkpoint_dir, cut_lineage
from ..sources import store
from ..sources.standins import numeric_samples, tabular_raw, tabular_samples, text_samples
from . import sqlkit as sk
from .q_grid import DIMS, LI, POSITIVE, SLOPE, STEPS, cols, newton_sql
from .q_image import CH, COLS, D as ID, FLIP_SQL, K, ROWS, _flips, _img
from .q_memorize import MODEL_SQL, _corpus
from .q_noise import DECAY, RATE, logits_sql, steps_sql
from .q_numeric import AUC_SQL, D, LAM, REMOVE, S_SQL, TAU, THETA
from .q_plans import _EDIT, _FIRST, _G, _SECOND, _numeric, _theta_df, cramer_sql
from .q_tabular import CHOSEN_N, CHOSEN_SEED, CHOSEN_SQL
from .registry import register

DRAW_N, DRAW_SEED, DRAW_DIMS = 200, 61, [0, 1]
ROUNDS, ROUND_N, ROUND_SEED = 2, 200, 67
C_VALUE = 0.001
EPOCHS, PATIENCE = 6, 2
BINS = 10
TRIGGER_SEED, N_TRIGGER, TRIGGER_TARGET, TRIGGER_SOURCE = 71, 25, 7, 1


# P14 --------------------------------------------------------------------------------------
def draw_sql(src: str, out: str, n: int, seed, dims=DRAW_DIMS) -> str:
    """CTEs {out}_c (chosen rows) and {out} (row_id, x0, x1): ``src`` after the draws."""
    parts = [f"{out}_c AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY {sk.ph('row_id', seed)}, row_id) AS rk FROM {src} QUALIFY rk <= {n})"]
    for j in dims:
        parts.append(f"{out}_v{j} AS MATERIALIZED (SELECT x{j} AS v, row_number() OVER (ORDER BY {sk.ph('row_id', f'{seed}:{j}')}, row_id) AS rk FROM {src} QUALIFY rk <= {n})")
    parts.append(f"{out} AS MATERIALIZED (SELECT s.row_id, s.y, " + ", ".join(f"CASE WHEN c.row_id IS NULL THEN s.x{j} ELSE v{j}.v END AS x{j}" for j in dims) +
                 f", c.row_id IS NOT NULL AS hit FROM {src} s LEFT JOIN {out}_c c USING (row_id) " + " ".join(f"LEFT JOIN {out}_v{j} v{j} ON v{j}.rk = c.rk" for j in dims) + ")")
    return ",\n".join(parts)


NUM = "num AS MATERIALIZED (SELECT row_id, y, n0 AS x0, n1 AS x1 FROM tab_imp WHERE split = 'train')"


def _two(spark, sf):
    """Train rows of the tabular task on its two numeric columns."""
    p = tabular_samples(spark, sf)
    return rw.remove_features(p.samples, list(range(2, p.d))).where("split = 'train'")


@register("p14_draw_values", sk.with_(sk.TAB, NUM, draw_sql("num", "dr", DRAW_N, DRAW_SEED)) + " SELECT row_id, round(x0, 9) AS x0, round(x1, 9) AS x1 FROM dr WHERE hit")
def p14_draw_values(spark, sf):
    """Seeded rows whose numeric columns are drawn anew from the columns' own values."""
    rows = _two(spark, sf)
    out = rw.draw_values(rows, DRAW_DIMS, DRAW_N, DRAW_SEED)
    m = F.map_from_arrays("idx", "val")
    some = rw.gather(out, sa.choose_rows(rows.select("row_id"), "row_id", DRAW_N, DRAW_SEED)).select("row_id", m.alias("m"))
    return some.select("row_id", *[F.round(F.coalesce(F.try_element_at("m", F.lit(j)), F.lit(0.0)), 9).alias(f"x{j}") for j in DRAW_DIMS])


# P16 --------------------------------------------------------------------------------------
@register("p16_change_set_by_rows", sk.with_(sk.TAB, CHOSEN_SQL, """
sc AS (SELECT r.row_id, r.y, coalesce(sum(e.value), 0) AS old, coalesce(sum(e.value) * 0.5, 0) AS new FROM tab_rows r JOIN chosen c USING (row_id)
  LEFT JOIN tab_entries e USING (row_id) GROUP BY r.row_id, r.y)""") + " SELECT row_id, y, -y AS y_delta, round(old, 9) AS old, round(new, 9) AS new FROM sc")
def p16_change_set_by_rows(spark, sf):
    """A change set from listed rows with new values (halved) and new labels."""
    p = tabular_samples(spark, sf)
    rows = p.samples
    chosen = sa.choose_rows(rows.select("row_id"), "row_id", CHOSEN_N, CHOSEN_SEED)
    new = rw.gather(rows, chosen).select("row_id", "idx", F.transform("val", lambda v: v * 0.5).alias("val"), (-F.col("y")).alias("y"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 9)
    return rw.rows_delta(rows, new, p.d).select("row_id", "y", "y_delta", total("val").alias("old"), total("val_delta").alias("new"))


# U4 ---------------------------------------------------------------------------------------
def _rounds_sql() -> str:
    out = [NUM, "s0 AS (SELECT " + ", ".join(f"{THETA[j]}::DOUBLE AS t{j}" for j in (0, 1)) + ")", "d0 AS (SELECT row_id, y, x0, x1 FROM num)"]
    for r in range(ROUNDS):
        out.append(draw_sql(f"d{r}", f"d{r + 1}", ROUND_N // ROUNDS, f"{ROUND_SEED}:{r}"))
        f = lambda x, sign: f"{sign} / (1 + exp(a.y * (t0 * {x}.x0 + t1 * {x}.x1))) * a.y"
        grads = ", ".join(f"sum({f('b', '-1')} * b.x{j} + {f('a', '1')} * a.x{j}) AS g{j}" for j in (0, 1))
        out.append(f"""g{r} AS MATERIALIZED (SELECT {grads} FROM d{r} a JOIN d{r + 1} b USING (row_id), s{r} WHERE b.hit),
h{r} AS MATERIALIZED (SELECT {", ".join(f"sum(p * (1 - p) * x{i} * x{j}) + {LAM if i == j else 0.0} AS h{i}{j}" for i, j in ((0, 0), (0, 1), (1, 1)))}
  FROM (SELECT d.*, 1 / (1 + exp(-(t0 * x0 + t1 * x1))) AS p FROM d{r + 1} d, s{r})),
s{r + 1} AS MATERIALIZED (SELECT {", ".join(f"t{j} - {cramer_sql([['h00', 'h01'], ['h01', 'h11']], ['g0', 'g1'], j)} AS t{j}" for j in (0, 1))} FROM s{r}, g{r}, h{r})""")
    return ",\n".join(out)


@register("u4_stepwise_replacement", sk.with_(sk.TAB, _rounds_sql()) + " " + " UNION ALL ".join(
    f"SELECT {r} AS step, {j} AS dim, round(t{j}, 5) AS theta FROM s{r + 1}" for r in range(ROUNDS) for j in (0, 1)))
def u4_stepwise_replacement(spark, sf):
    """Second-order updates over rounds of replaced values; theta and rows carry over."""
    steps = ul.stepwise_replacement(_two(spark, sf), DRAW_DIMS, ROUND_N, ROUNDS, THETA[:2], 2, LAM, ROUND_SEED)
    return spark.createDataFrame([(r, j, round(float(t[j]), 5)) for r, t in enumerate(steps) for j in (0, 1)], "step int, dim int, theta double")


# U5 ---------------------------------------------------------------------------------------
@register("u5_label_influence", sk.with_(sk.TAB, CHOSEN_SQL, "num AS MATERIALIZED (SELECT row_id, y, n0 AS x0, n1 AS x1 FROM tab_imp WHERE split = 'train')", f"""
sc AS (SELECT *, {THETA[0]} * x0 + {THETA[1]} * x1 AS s FROM num),
g AS (SELECT {", ".join(f"sum(y / (1 + exp(-y * s)) * x{j} + y / (1 + exp(y * s)) * x{j}) AS g{j}" for j in (0, 1))} FROM sc WHERE row_id IN (SELECT row_id FROM chosen)),
h AS (SELECT {", ".join(f"sum(x{i} * x{j} / (1 + exp(s)) / (1 + exp(-s))) + {LAM if i == j else 0.0} AS h{i}{j}" for i, j in ((0, 0), (0, 1), (1, 1)))} FROM sc)""") + " " + " UNION ALL ".join(
    [f"SELECT '{m}' AS method, {j} AS dim, round({THETA[j]} - {cramer_sql([['h00', 'h01'], ['h01', 'h11']], ['g0', 'g1'], j)}, 6) AS theta FROM g, h" for m in ("influence", "again") for j in (0, 1)] +
    [f"SELECT 'lazy', {j}, {THETA[j]}::DOUBLE" for j in (0, 1)]))
def u5_label_influence(spark, sf):
    """Influence of flipped labels; the second update takes the inverse Hessian of the first."""
    p = tabular_samples(spark, sf)
    chosen = sa.choose_rows(p.samples.select("row_id"), "row_id", CHOSEN_N, CHOSEN_SEED)
    rows = rw.remove_features(p.samples, list(range(2, p.d))).where("split = 'train'")
    delta, flipped, inverse = rw.flip_delta(rows, chosen), rw.flip_labels(rows, chosen), {}
    first = ul.influence_methods(rows, flipped, delta, THETA[:2], 2, LAM, ("influence", "lazy"), inverse)
    again = ul.influence_methods(rows, flipped, delta, THETA[:2], 2, LAM, ("influence",), inverse)
    out = {"influence": first["influence"], "again": again["influence"], "lazy": first["lazy"]}
    return spark.createDataFrame([(m, j, round(float(t[j]), 6)) for m, t in out.items() for j in (0, 1)], "method string, dim int, theta double")


# U8 ---------------------------------------------------------------------------------------
@register("u8_update_dispatch", _EDIT + " " + " UNION ALL ".join(
    [f"SELECT 'order1' AS method, {j} AS dim, round({e}, 5) AS theta FROM he" for j, e in enumerate(_FIRST)] +
    [f"SELECT 'order2', {j}, round({e}, 5) FROM he" for j, e in enumerate(_SECOND)] + [f"SELECT 'no change', {j}, {t}::DOUBLE" for j, t in enumerate(THETA)]))
def u8_update_dispatch(spark, sf):
    """One dispatcher for both orders; a change set without gradient moves nothing."""
    with _numeric(spark, sf) as (_, edited, delta, _):
        same = map_packs(delta, lambda b: type(b).from_pydict({c + end: b.column(c) for end in ("", "_delta") for c in b.schema.names if not c.endswith("_delta")}))
        out = {"order1": ul.approx_retraining(delta, edited, THETA, D, LAM, 1, TAU)[0], "order2": ul.approx_retraining(delta, edited, THETA, D, LAM, 2)[0],
               "no change": ul.approx_retraining(same, edited, THETA, D, LAM, 2)[0]}
    return spark.createDataFrame([(m, j, round(float(t[j]), 5)) for m, t in out.items() for j in range(D)], "method string, dim int, theta double")


# M2 / A17 -----------------------------------------------------------------------------------
_FIT_C = sk.with_(LI, "tr AS MATERIALIZED (SELECT * FROM li_rows WHERE split = 'train')",
                  f"cell AS (SELECT 0 AS cell, 1.0 / {C_VALUE} AS lam, {cols('0.0::DOUBLE AS b{j}')})", newton_sql("n", "tr", "cell", []))


@register("m2_fit_average_loss", _FIT_C + " " + " UNION ALL ".join(f"SELECT {j} AS dim, round(t{j}, 6) AS theta FROM n{STEPS}" for j in DIMS))
def m2_fit_average_loss(spark, sf):
    """The fit with C = 1 / (n lambda) on the average loss: the same minimum as lambda n = 1 / C on the sum."""
    rows = numeric_samples(spark, sf, positive=POSITIVE).samples.where("split = 'train'")
    lam = 1 / (C_VALUE * rows.count())                       # of the average loss
    return _theta_df(spark, gr.fit_grid(rows, gr.grid(np.zeros(D)), lam * rows.count())[0], nd=6)


@register("a17_performance_bundle", sk.with_(LI, f"scoredp AS (SELECT y, 1 / (1 + exp(-{S_SQL})) AS p FROM li_rows WHERE split = 'test')") + "," + AUC_SQL.replace("SELECT round(sum(roc), 6)", f""",
areas AS (SELECT round(sum(roc), 6)""") + f"""),
scr AS (SELECT split, y, {cols('x{j}')}, {S_SQL} AS s FROM li_rows),
per AS (SELECT split, count(*) AS n, count(*) FILTER (y > 0) AS p, count(*) FILTER (s >= 0) AS q, count(*) FILTER (y > 0 AND s >= 0) AS tp,
  sum(ln(1 + exp(-abs(y * s))) + greatest(-y * s, 0)) + {0.5 * LAM * sum(t * t for t in THETA)} AS loss, {SLOPE} FROM scr GROUP BY split),
f AS (SELECT *, 2 * tp / greatest(p + q, 1) AS up, 2 * (n - p - q + tp) / greatest(2 * n - p - q, 1) AS dn, {" + ".join(f"power(d{j} + {LAM * THETA[j]}, 2)" for j in DIMS)} AS g FROM per)
SELECT round(t.loss, 4) AS test_loss, round(t.g, 2) AS test_gradient_norm, round((t.n - t.p - t.q + 2 * t.tp) / t.n, 6) AS accuracy, round((t.up + t.dn) / 2, 6) AS macro_f1,
  round((t.up * t.p + t.dn * (t.n - t.p)) / t.n, 6) AS weighted_f1, round(r.loss, 4) AS train_loss, round(r.g, 2) AS train_gradient_norm, roc_auc, pr_auc
FROM (SELECT * FROM f WHERE split = 'test') t, (SELECT * FROM f WHERE split = 'train') r, areas""")
def a17_performance_bundle(spark, sf):
    """Everything a model is judged by on test and train, in one row."""
    rows = numeric_samples(spark, sf, positive=POSITIVE).samples
    out = gr.performance(rows.where("split = 'train'"), rows.where("split = 'test'"), THETA, LAM)
    nd = {"test_loss": 4, "train_loss": 4, "test_gradient_norm": 2, "train_gradient_norm": 2}
    return out.select(*[F.round(c, nd.get(c, 6)).alias(c) for c in out.columns])


# W6 / W7 ----------------------------------------------------------------------------------
RUNS = {"slow": RATE, "fast": 400.0}


def _log_sql() -> str:
    ep = " UNION ALL ".join(f"SELECT '{run}' AS run, {e} AS epoch, -avg(ln(p)) AS loss FROM {run}_m{e} WHERE cls = label" for run in RUNS for e in range(EPOCHS + 1))
    return ",\n".join(["tr AS (SELECT row_id, label FROM img WHERE split = 'train')", *(steps_sql("0.0", "tr", rate, EPOCHS, DECAY, f"{run}_") for run, rate in RUNS.items()),
                       f"ep AS MATERIALIZED ({ep})"])


def _runs(spark, sf):
    train = _img(spark, sf).where("split = 'train'")
    rows = [(run, e, v) for run, rate in RUNS.items() for e, v in noise.gradient_steps(train, np.zeros((K, ID)), rate, EPOCHS, DECAY)[2]]
    return spark.createDataFrame(rows, "run string, epoch int, loss double")


@register("w6_best_epoch", sk.with_(sk.IMG, _log_sql()) + " SELECT run, CAST(arg_min(epoch, (loss, epoch)) AS INTEGER) AS best_epoch, round(min(loss), 6) AS best_loss FROM ep GROUP BY run")
def w6_best_epoch(spark, sf):
    """First epoch of least loss of every training run."""
    return me.best_epoch(_runs(spark, sf), ["run"], "loss").select("run", "best_epoch", F.round("best_loss", 6).alias("best_loss"))


@register("w7_early_stop", sk.with_(sk.IMG, _log_sql(), f"""
so AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch) AS least FROM ep),
nw AS (SELECT a.run, a.epoch, a.least, (SELECT max(b.epoch) FROM so b WHERE b.run = a.run AND b.epoch <= a.epoch AND b.loss = b.least
  AND NOT EXISTS (SELECT 1 FROM so c WHERE c.run = b.run AND c.epoch < b.epoch AND c.loss <= b.loss)) AS last_new FROM so a),
st AS (SELECT run, coalesce(min(epoch) FILTER (epoch - last_new >= {PATIENCE}), max(epoch)) AS stop FROM nw GROUP BY run)""") + """
SELECT nw.run, CAST(stop AS INTEGER) AS stop_epoch, round(least, 6) AS least FROM nw JOIN st ON st.run = nw.run AND nw.epoch = st.stop""")
def w7_early_stop(spark, sf):
    """Where a run stops that waits some epochs for a new minimum."""
    return me.early_stop(_runs(spark, sf), PATIENCE).select("run", "stop_epoch", F.round("least", 6).alias("least"))


# F11 / E9 ---------------------------------------------------------------------------------
@register("f11_encode_decode", sk.with_(MODEL_SQL, """
voc AS MATERIALIZED (SELECT c AS ch, CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM corpus WHERE doc_id % 2 = 0)),
ch AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) AS i, unnest(string_split(text, '')) AS c FROM corpus WHERE text <> ''),
co AS (SELECT doc_id, i, c, code FROM ch LEFT JOIN voc ON ch = c)""") + """
SELECT d.doc_id, count(i) AS n_codes, count(i) FILTER (code IS NULL) AS unknown, CAST(coalesce(sum(code), 0) AS BIGINT) AS total,
  md5(coalesce(string_agg(CASE WHEN code IS NULL THEN chr(65533) ELSE c END, '' ORDER BY i), '')) AS decoded_md5
FROM corpus d LEFT JOIN co ON co.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def f11_encode_decode(spark, sf):
    """All texts coded by the vocabulary of half of them, and decoded again."""
    c = _corpus(spark, sf)
    vocab = cut_lineage(fe.char_vocab(c.where("doc_id % 2 = 0")))
    out = fe.decode_text(fe.encode_text(c.where("text is not null"), vocab), vocab, name="decoded")
    known = F.filter("codes", lambda v: v.isNotNull())
    return out.select("doc_id", F.size("codes").cast("bigint").alias("n_codes"), (F.size("codes") - F.size(known)).cast("bigint").alias("unknown"),
                      F.aggregate(known, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"), F.md5("decoded").alias("decoded_md5"))


# Q11 --------------------------------------------------------------------------------------
def _summary_sql() -> str:
    number = lambda c: f"""SELECT '{c}' AS "column", 'double' AS type, CAST(CAST(least(floor(({c} - (SELECT min({c}) FROM tab_raw)) / (SELECT max({c}) - min({c}) FROM tab_raw) * {BINS}) + 1, {BINS}) AS BIGINT) AS VARCHAR) AS bucket, y AS label FROM tab_raw"""
    text = lambda c: f"""SELECT '{c}' AS "column", 'string' AS type, {c} AS bucket, y AS label FROM tab_raw"""
    return sk.with_(sk.TAB) + f""" SELECT "column", type, bucket, label, count(*) AS n FROM ({" UNION ALL ".join([number("c_acctbal"), number("o_totalprice"), text("c_mktsegment"), text("o_orderpriority")])}) GROUP BY ALL"""


@register("q11_data_summary", _summary_sql())
def q11_data_summary(spark, sf):
    """Types, histograms and value counts by label of all columns."""
    return data_summary(tabular_raw(spark, sf).drop("row_id", "split"), "y", bins=BINS)


# B5 ---------------------------------------------------------------------------------------
FITTING = [p for p in tg.PRESETS if p != "cross-centered-large"]        # 6 cells do not end in the middle of 8 x 8


def _preset_sql(name: str) -> str:
    """Added value at position j (0-based)."""
    kind, how = tg.PRESETS[name]
    if kind == "cross":
        size, off = how.get("size", 2), how.get("offset", 0)
        low, right = (ROWS // 2, COLS // 2) if how.get("center") else (ROWS - off, COLS - off)
        cells = {((low - 1 - i) * COLS + right - 1 - i) for i in range(size + 1)} | {((low - 1 - i) * COLS + right - 1 - size + i) for i in range(size + 1)}
        return f"CASE WHEN j // {CH} IN ({', '.join(map(str, sorted(cells)))}) THEN {how.get('value', 0.5)} ELSE 0.0 END"
    if kind == "distributed":
        return f"CASE WHEN j // {CH} IN (SELECT ({sk.ph('k', f'{TRIGGER_SEED}:r')} % {ROWS}) * {COLS} + {sk.ph('k', f'{TRIGGER_SEED}:c')} % {COLS} FROM range(10) r(k)) THEN 0.5 ELSE 0.0 END"
    if kind == "features":
        return f"CASE WHEN j IN (SELECT {sk.ph('k', TRIGGER_SEED)} % {ID} FROM range({how['n']}) r(k)) THEN 1.0 ELSE 0.0 END"
    return f"{sk.unif('j', TRIGGER_SEED)} * 0.1"


SHIFTED = "sh AS MATERIALIZED (SELECT row_id, split, label, list_transform(x, lambda v: (v + 1) / 2) AS x FROM img)"


def _pattern_cte(name: str, cte: str) -> str:
    return f"{cte} AS MATERIALIZED (SELECT list(CAST({_preset_sql(name)} AS DOUBLE) ORDER BY j) AS p FROM range({ID}) r(j))"


def _stamped(x: str, p: str) -> str:
    return f"list_transform(list_zip({x}, {p}), lambda t: greatest(least(t[1] + t[2], 1.0), 0.0))"


def _shifted(spark, sf):
    return _img(spark, sf).withColumn("x", F.transform("x", lambda v: (v + 1) / 2))


@register("b5_trigger_presets", sk.with_(sk.IMG, SHIFTED, *[_pattern_cte(p, f"p{i}") for i, p in enumerate(FITTING)]) + " " + " UNION ALL ".join(f"""
SELECT '{p}' AS preset, count(*) AS n, round(sum(list_sum({_stamped('x', 'p')}) - list_sum(x)), 4) AS added FROM sh, p{i}""" for i, p in enumerate(FITTING)))
def b5_trigger_presets(spark, sf):
    """Every named pattern stamped on all rows, in one pass."""
    rows = _shifted(spark, sf)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    sums = [F.sum(total(tg.stamp("x", tg.preset(p, ROWS, COLS, CH, TRIGGER_SEED))) - total(F.col("x"))).alias(p) for p in FITTING]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(p).alias("preset"), F.round(F.col(f"`{p}`"), 4).alias("added")) for p in FITTING])).alias("r")).select("r.preset", "n", "r.added")


# B7 / B8 ----------------------------------------------------------------------------------
def inject_sql(n: int, source: int, split: str, name: str) -> str:
    able = f"label <> {TRIGGER_TARGET}" if source == -1 else f"label = {source}"
    limit = "" if n == -1 else f" ORDER BY {sk.ph('row_id', TRIGGER_SEED)}, row_id LIMIT {n}"
    return f"{name} AS MATERIALIZED (SELECT row_id, label AS old_label, x AS orig FROM sh WHERE split = '{split}' AND {able}{limit})"


@register("b7_backdoor_variants", sk.with_(sk.IMG, SHIFTED, _pattern_cte("cross-offset", "pt"), inject_sql(N_TRIGGER, -1, "train", "a"), inject_sql(-1, TRIGGER_SOURCE, "train", "b"),
                                           inject_sql(-1, -1, "valid", "c")) + " UNION ALL ".join(f"""
SELECT '{v}' AS variant, s.row_id, {"s.label" if v == "valid" else f"CASE WHEN i.row_id IS NULL THEN s.label ELSE {TRIGGER_TARGET} END"} AS label,
  round(list_sum(CASE WHEN i.row_id IS NULL THEN s.x ELSE {_stamped('s.x', 'p')} END), 6) AS x_sum FROM sh s LEFT JOIN {t} i USING (row_id), pt WHERE s.split = '{sp}'"""
                                           for v, t, sp in (("any class", "a", "train"), ("all of one", "b", "train"), ("valid", "c", "valid"))))
def b7_backdoor_variants(spark, sf):
    """Trigger rows of any class but the target, all of one class, and a validation set that keeps its labels."""
    rows, pattern, out = _shifted(spark, sf), tg.preset("cross-offset", ROWS, COLS, CH), None
    for variant, split, n, source in (("any class", "train", N_TRIGGER, -1), ("all of one", "train", -1, TRIGGER_SOURCE), ("valid", "valid", -1, -1)):
        hit, _ = tg.inject(rows.where(F.col("split") == split), pattern, n, source, TRIGGER_TARGET, TRIGGER_SEED, keep_labels=split == "valid")
        part = hit.select(F.lit(variant).alias("variant"), "row_id", "label", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("x_sum"))
        out = part if out is None else out.unionByName(part)
    return out


@register("b8_restore_subset", sk.with_(sk.IMG, SHIFTED, _pattern_cte("cross-offset", "pt"), inject_sql(N_TRIGGER, -1, "train", "a")) + f"""
SELECT s.row_id, CASE WHEN i.row_id IS NULL OR s.row_id % 2 = 0 THEN s.label ELSE {TRIGGER_TARGET} END AS label,
  round(list_sum(CASE WHEN i.row_id IS NULL OR s.row_id % 2 = 0 THEN s.x ELSE {_stamped('s.x', 'p')} END), 6) AS x_sum FROM sh s LEFT JOIN a i USING (row_id), pt WHERE s.split = 'train'""")
def b8_restore_subset(spark, sf):
    """Originals put back for the trigger rows with an even key; the store is written and read again."""
    rows = _shifted(spark, sf).where("split = 'train'")
    hit, kept = tg.inject(rows, tg.preset("cross-offset", ROWS, COLS, CH), N_TRIGGER, -1, TRIGGER_TARGET, TRIGGER_SEED)
    folder = f"{checkpoint_dir(spark)}/injector-{uuid.uuid4().hex}"
    store.save_injected(kept, folder, TRIGGER_SEED)
    back = tg.restore(hit, store.load_injected(spark, folder).drop("seed"), rows.where("row_id % 2 = 0"))
    return back.select("row_id", "label", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("x_sum"))


# B9 ---------------------------------------------------------------------------------------
@register("b9_flipped_model", sk.with_(sk.IMG, FLIP_SQL, "tc AS (SELECT row_id, label FROM img WHERE split = 'train')",
                                       "tf AS (SELECT t.row_id, coalesce(f.new_label, t.label) AS label FROM tc t LEFT JOIN flips f USING (row_id))",
                                       "va AS (SELECT row_id, label FROM img WHERE split = 'valid')", steps_sql("0.0", "tc", RATE, 2, DECAY, "c"), steps_sql("0.0", "tf", RATE, 2, DECAY, "f"),
                                       logits_sql("vc", "cw2", "va"), logits_sql("vf", "fw2", "va")) + """
SELECT (SELECT round(avg((pred = label)::INT), 6) FROM (SELECT DISTINCT row_id, label, pred FROM vf)) AS flipped_accuracy,
       (SELECT round(avg((pred = label)::INT), 6) FROM (SELECT DISTINCT row_id, label, pred FROM vc)) AS retrained_accuracy""")
def b9_flipped_model(spark, sf):
    """Accuracy on clean validation rows of the model trained on flipped labels, and of one retrained."""
    from ..operators import softmax as sm
    img = _img(spark, sf)
    train, valid = img.where("split = 'train'"), img.where("split = 'valid'")
    flipped = train.join(_flips(spark, sf).select("row_id", "new_label"), "row_id", "left").withColumn("label", F.coalesce("new_label", "label"))
    acc = [sm.predict(valid, noise.gradient_steps(rows, np.zeros((K, ID)), RATE, 2, DECAY)[1]).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]
           for rows in (flipped, train)]
    return spark.createDataFrame([tuple(round(a, 6) for a in acc)], "flipped_accuracy double, retrained_accuracy double")


# S6 / S8 / S9 / S14 / S16 --------------------------------------------------------------------
@register("s6_s8_prepared_round_trip", sk.with_(sk.TAB, "nn AS (SELECT row_id, sqrt(sum(value * value)) AS n FROM tab_entries GROUP BY row_id)") + """
SELECT e.row_id, e.split, e.y, e.dim, round(value / n, 9) AS value FROM tab_entries e JOIN nn USING (row_id)""")
def s6_s8_prepared_round_trip(spark, sf):
    """The tabular dataset written, and read again with rows of unit length."""
    folder = f"{checkpoint_dir(spark)}/prepared-{uuid.uuid4().hex}"
    store.save_prepared(tabular_samples(spark, sf), folder, "tabular")
    p = store.load_prepared(spark, folder, "tabular", ["tabular"], normalize=True)
    return p.samples.select("row_id", "split", "y", F.explode(F.arrays_zip(F.col("idx").alias("dim"), F.col("val").alias("value"))).alias("e")).select(
        "row_id", "split", "y", "e.dim", F.round("e.value", 9).alias("value"))


@register("s9_relevant_features", sk.with_(sk.text()) + " SELECT dim, feature FROM txt_vocab WHERE contains(feature, 'th') OR contains(feature, 'qu')")
def s9_relevant_features(spark, sf):
    """The sensitive terms of the text model, written as a list and read again."""
    folder = f"{checkpoint_dir(spark)}/relevant-{uuid.uuid4().hex}"
    vocab = text_samples(spark, sf).vocab
    store.save_relevant(vocab, ["th", "qu"], folder, "text")
    return store.load_relevant(spark, folder, "text", vocab)


@register("s14_model_store", _EDIT + f""", key AS (SELECT sha256('{"-".join(map(str, REMOVE))}') AS model_id)
""" + " UNION ALL ".join([f"SELECT model_id, 'theta' AS part, '{j}' AS name, round({e}, 5) AS value FROM he, key" for j, e in enumerate(_SECOND)] +
                         [f"SELECT model_id, 'report', 'gradient', round(sqrt({' + '.join(f'power({g}, 2)' for g in _G)}), 4) FROM key"]))
def s14_model_store(spark, sf):
    """The updated model and a report under the hash of its removed columns."""
    folder = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    with _numeric(spark, sf) as (_, edited, _, G):
        store.save_model(spark, folder, REMOVE, ul.second_order(edited, THETA, G, D, LAM), {"gradient": float(np.linalg.norm(G))})
    theta, report = store.load_models(spark, folder)
    return theta.select("model_id", F.lit("theta").alias("part"), F.col("dim").cast("string").alias("name"), F.round("w", 5).alias("value")).unionByName(
        report.select("model_id", F.lit("report").alias("part"), F.col("metric").alias("name"), F.round("value", 4).alias("value")))


@register("s16_shard_store", sk.with_(sk.TAB, NUM, f"sd AS MATERIALIZED (SELECT *, {sk.ph('row_id', 3)} % 5 AS shard FROM num)") + f"""
SELECT CAST(shard AS INTEGER) AS shard, count(*) AS n, sum(row_id)::BIGINT AS keys, {THETA[0]}::DOUBLE AS t0, {THETA[1]}::DOUBLE AS t1 FROM sd GROUP BY shard""")
def s16_shard_store(spark, sf):
    """Row sets and models of the shards, written and read again."""
    folder = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = sa.assign_shards(_two(spark, sf), "row_id", 5, 3)
    store.save_shards(rows, {s: np.array(THETA[:2]) for s in range(5)}, folder)
    sets, models = store.load_shards(spark, folder)
    t = spark.createDataFrame([(s, float(m[0]), float(m[1])) for s, m in models.items()], "shard int, t0 double, t1 double")
    return sets.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("keys")).join(t, "shard")
