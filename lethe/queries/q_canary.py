"""Canary work beyond the count model's perplexity: skew-normal exposure, sampled replacement text,
the canary report, and unlearning from a trained softmax head over one-hot contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import memorize as mz
from ..plans import text_head as th
from . import sqlkit as sk
from .q_memorize import (ALPHA, DIST_SQL, MODEL_SQL, ORDER, PROMPT, REPLACED, _asked, _both, _canary_positions, _dist, _model, _sampled,
                         corpus_sql, pos_sql, scored_sql, sql_str, windows_sql)
from .registry import register

SECRET, REFERENCE = mz.CANARY_NUMBER, mz.CANARY_REPLACEMENT[0]
DRAW_STEPS, DRAW_TOP, DRAW_SEED = 3, 3, 53
HEAD_ORDER, HEAD_EPOCHS, HEAD_RATE = 2, 3, 4.0
HEAD_TAU, HEAD_DAMPING, HEAD_CG = 2.0, 0.05, 14
REDUCTION, REDUCE_SEED = 0.25, 59


# F13 / X4b ------------------------------------------------------------------------------
def exposure_sql(dist: str, values: str) -> str:
    """CTEs fit and expo(pp, cdf): the skew-normal fitted to ``dist`` (pp) at the ``values`` (pp)."""
    nodes = ", ".join(f"({u!r}, {w!r})" for u, w in mz.gauss_legendre())
    h = mz.TAIL / mz.SIMPSON_PANELS
    x = "greatest(least(alpha * t, 8.0), -8.0)"
    return f"""
mom AS (SELECT avg(pp) AS m, stddev_pop(pp) AS s, avg(power(pp - (SELECT avg(pp) FROM {dist}), 3)) / power(stddev_pop(pp), 3) AS g0 FROM {dist}),
skew AS (SELECT m, s, greatest(least(coalesce(g0, 0), 0.995), -0.995) AS g FROM mom),
dlt AS (SELECT *, sign(g) * sqrt(pi() / 2 * a * a / (1 + a * a)) AS d FROM (SELECT *, power(2 * abs(g) / (4 - pi()), 1.0 / 3) AS a FROM skew)),
fit AS MATERIALIZED (SELECT m - s / sqrt(1 - 2 * d * d / pi()) * d * sqrt(2 / pi()) AS xi, s / sqrt(1 - 2 * d * d / pi()) AS omega, d / sqrt(1 - d * d) AS alpha FROM dlt),
node(u, w) AS (VALUES {nodes}),
panel AS (SELECT pp, i, alpha, (pp - xi) / omega - {mz.TAIL} + {h} * i AS t FROM {values}, fit, range({mz.SIMPSON_PANELS + 1}) r(i)),
phi AS (SELECT pp, i, t, 0.5 + any_value({x}) * sum(w * exp(-power({x}, 2) * u * u / 2)) / sqrt(2 * pi()) AS ph FROM panel, node GROUP BY pp, i, t),
expo AS MATERIALIZED (SELECT pp, least(sum(CASE WHEN i IN (0, {mz.SIMPSON_PANELS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {h / 3} * 2 / sqrt(2 * pi()) * exp(-t * t / 2) * ph), 1.0) AS cdf
  FROM phi GROUP BY pp)"""


@register("f13_x4_skewnorm_exposure", DIST_SQL + ", " + pos_sql(mz.CANARY_START, SECRET) + "," + scored_sql("seqpos", "sc") +
          ", cv AS MATERIALIZED (SELECT sum(-log2(p)) AS pp FROM sc UNION SELECT quantile_cont(pp, 0.5) FROM dist)," + exposure_sql("dist", "cv") +
          " SELECT round(pp, 6) AS pp, round(cdf, 7) AS cdf, round(-log2(cdf), 4) AS exposure FROM expo")
def f13_x4_skewnorm_exposure(spark, sf):
    """Exposure of the secret, and of the median sequence, under the fitted skew-normal."""
    counts, V = _asked(spark, sf, _sampled(spark), _canary_positions(spark))
    dist = _dist(spark, counts, V)
    pp = mz.sequence_perplexity(spark, counts, mz.CANARY_START, SECRET, ORDER, V, ALPHA).agg(F.max("running").alias("pp"))
    values = pp.unionByName(dist.agg(F.percentile("pp", F.lit(0.5)).alias("pp"))).distinct()
    out = mz.skewnorm_exposure(dist, values)
    return out.select(F.round("pp", 6).alias("pp"), F.round("cdf", 7).alias("cdf"), F.round("exposure", 4).alias("exposure"))


# X6 / T5 --------------------------------------------------------------------------------
def _draw_sql(weighted: bool) -> str:
    weight = "n::DOUBLE" if weighted else "1.0::DOUBLE"
    out = []
    for step in range(DRAW_STEPS):
        ranks = f"rank BETWEEN 2 AND {DRAW_TOP + 1}" if step == 0 else f"rank <= {DRAW_TOP}"
        key = "sid::VARCHAR || ':" + str(step) + "'"
        out.append(f"""
c{step} AS MATERIALIZED (SELECT ctx, next, rank, sum({weight}) OVER (PARTITION BY ctx ORDER BY rank) AS run, sum({weight}) OVER (PARTITION BY ctx) AS total FROM best WHERE {ranks}),
d{step + 1} AS MATERIALIZED (SELECT d.sid, d.start, d.gen || coalesce((SELECT c.next FROM c{step} c WHERE c.ctx = right(d.start || d.gen, {ORDER}) AND c.run > {sk.unif(key, DRAW_SEED)} * c.total
    ORDER BY c.rank LIMIT 1), (SELECT c FROM minc)) AS gen FROM d{step} d)""")
    return ",".join(out)


DRAW_SQL = MODEL_SQL + f""",
best AS MATERIALIZED (SELECT * FROM (SELECT ctx, next, n, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, next) AS rank FROM counts) WHERE rank <= {DRAW_TOP + 1}),
minc AS MATERIALIZED (SELECT min(c) AS c FROM (SELECT unnest(string_split(text, '')) AS c FROM corpus)),
d0 AS (SELECT -1 AS sid, {sql_str(mz.CANARY_START)} AS start, '' AS gen UNION ALL SELECT doc_id, substring(text, 1, {PROMPT}), '' FROM corpus WHERE length(text) >= 1),"""


def _drawn(spark, sf, weighted):
    c, counts, _ = _model(spark, sf)
    low = fe.char_vocab(c).where("code = 0").collect()[0]["ch"]
    starts = c.where(F.length("text") >= 1).select(F.col("doc_id").alias("sid"), F.substring("text", 1, PROMPT).alias("start"))
    starts = starts.unionByName(spark.createDataFrame([(-1, mz.CANARY_START)], "sid bigint, start string"))
    return mz.sampled_continue(starts, counts, ORDER, DRAW_STEPS, DRAW_TOP, DRAW_SEED, low, weighted=weighted).select("sid", "gen")


@register("x6_sampled_replacement", sk.with_(DRAW_SQL + _draw_sql(False)) + f" SELECT sid, gen FROM d{DRAW_STEPS}")
def x6_sampled_replacement(spark, sf):
    """Replacement text drawn from the most likely characters, the likeliest first one left out."""
    return _drawn(spark, sf, False)


@register("x6_sampled_by_probability", sk.with_(DRAW_SQL + _draw_sql(True)) + f" SELECT sid, gen FROM d{DRAW_STEPS}")
def x6_sampled_by_probability(spark, sf):
    """The same, each character drawn in proportion to its count."""
    return _drawn(spark, sf, True)


# X7 / Q9 --------------------------------------------------------------------------------
def ref_sql(name: str, counts: str = "counts", tot: str = "tot") -> str:
    return f"{name}_pos AS (SELECT i, ctx, '{REFERENCE}' AS ch FROM seqpos)," + scored_sql(f"{name}_pos", name, counts, tot)


def fit_sql(name: str, counts: str, tot: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT sum(n) AS windows, sum(-n * ln((n + {ALPHA}) / (tot + {ALPHA} * (SELECT V FROM vsize)))) / sum(n) AS loss,
  sum(CASE WHEN rk = 1 THEN n ELSE 0 END) / sum(n) AS accuracy FROM (SELECT c.*, t.tot, row_number() OVER (PARTITION BY c.ctx ORDER BY n DESC, next) AS rk FROM {counts} c JOIN {tot} t USING (ctx)))"""


@register("x7_canary_digits", sk.with_(MODEL_SQL, pos_sql(mz.CANARY_START, SECRET), scored_sql("seqpos", "sc"), ref_sql("rf")) + """
SELECT CAST(s.i AS INTEGER) AS i, round(s.p, 9) AS p_secret, round(r.p, 9) AS p_reference, round(sum(-log2(s.p)) OVER (ORDER BY s.i ROWS UNBOUNDED PRECEDING), 6) AS running
FROM sc s JOIN rf r ON r.i = s.i""")
def x7_canary_digits(spark, sf):
    """Per character of the secret: its probability, the replacement's, and the running perplexity."""
    counts, V = _asked(spark, sf, _canary_positions(spark))
    out = mz.canary_digits(spark, counts, mz.CANARY_START, SECRET, REFERENCE, ORDER, V, ALPHA)
    return out.select("i", F.round("p_secret", 9).alias("p_secret"), F.round("p_reference", 9).alias("p_reference"), F.round("running", 6).alias("running"))


CLEAN_SQL = corpus_sql("cl", REPLACED) + ", clean AS MATERIALIZED (SELECT doc_id, lower(raw) AS text FROM cl)," + windows_sql("clean", "cwin")
AFTER_SQL = CLEAN_SQL + """,
after AS MATERIALIZED (SELECT ctx, next, count(*) AS n FROM cwin GROUP BY ctx, next), after_tot AS MATERIALIZED (SELECT ctx, sum(n) AS tot FROM after GROUP BY ctx)"""


@register("q9_canary_report", sk.with_(MODEL_SQL, AFTER_SQL, pos_sql(mz.CANARY_START, SECRET), scored_sql("seqpos", "s_before"), scored_sql("seqpos", "s_after", "after", "after_tot"),
                                       ref_sql("r_before"), ref_sql("r_after", "after", "after_tot"), fit_sql("f_before", "counts", "tot"), fit_sql("f_after", "after", "after_tot")) +
          " UNION ALL ".join(f"""
SELECT '{s}' AS state, (SELECT round(sum(-log2(p)), 6) FROM s_{s}) AS perplexity, (SELECT round(avg(p), 9) FROM s_{s}) AS p_secret, (SELECT round(avg(p), 9) FROM r_{s}) AS p_reference,
       round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM f_{s}""" for s in ("before", "after")))
def q9_canary_report(spark, sf):
    """The canary before and after unlearning: perplexity of the secret, probability of secret and
    replacement, and what the removal costs the model on its corpus."""
    from ..session import cut_lineage
    both = _both(spark, sf)
    before = cut_lineage(mz.kgram_counts(both.select("doc_id", F.col("old").alias("text")), ORDER))
    after = cut_lineage(mz.unlearn_counts(before, mz.changed_windows(both, ORDER)))
    V = fe.char_vocab(both.select("doc_id", F.col("old").alias("text"))).count()
    out = None
    for state, counts in (("before", before), ("after", after)):
        digits = mz.canary_digits(spark, counts, mz.CANARY_START, SECRET, REFERENCE, ORDER, V, ALPHA).agg(
            F.round(F.max("running"), 6).alias("perplexity"), F.round(F.avg("p_secret"), 9).alias("p_secret"), F.round(F.avg("p_reference"), 9).alias("p_reference"))
        row = digits.crossJoin(mz.count_model_fit(counts, V, ALPHA)).select(F.lit(state).alias("state"), "perplexity", "p_secret", "p_reference",
                                                                            F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


# J5 -------------------------------------------------------------------------------------
@register("j5_reduced_windows", sk.with_(MODEL_SQL, CLEAN_SQL, f"""
every AS MATERIALIZED (SELECT w.doc_id, w.pos, w.ctx, w.next, c.doc_id IS NULL OR w.ctx <> c.ctx OR w.next <> c.next AS is_changed,
  row_number() OVER (PARTITION BY c.doc_id IS NULL OR w.ctx <> c.ctx OR w.next <> c.next
    ORDER BY {sk.ph("w.doc_id::VARCHAR || ':' || w.pos::VARCHAR", REDUCE_SEED)}, w.doc_id::VARCHAR || ':' || w.pos::VARCHAR) AS rn
  FROM win w LEFT JOIN cwin c ON c.doc_id = w.doc_id AND c.pos = w.pos),
quota AS (SELECT ceil({REDUCTION} * count(*) FILTER (is_changed)) AS d, floor({REDUCTION} * count(*)) AS n FROM every)""") + """
SELECT doc_id, pos, ctx, next, is_changed FROM every, quota WHERE rn <= CASE WHEN is_changed THEN d ELSE greatest(n - d, 0) END""")
def j5_reduced_windows(spark, sf):
    """The windows reduced to a share, the changed ones at their own, each mapped to the change set."""
    both = _both(spark, sf)
    # texts are dealt out by the key of the change set, which is cheaper than dealing out their windows
    windows = fe.char_windows(both.select("doc_id", F.col("old").alias("text")).repartition("doc_id"), "doc_id", ORDER, packed=True)
    changed = mz.changed_windows(both, ORDER).where("old_ctx is not null")
    return th.reduced_windows(windows, changed, REDUCTION, REDUCE_SEED, length=ORDER)


# U13 on a trained head --------------------------------------------------------------------
def _head_windows(src: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT ctx, next, count(*) AS n FROM (SELECT substring(text, p + 1, {HEAD_ORDER}) AS ctx, substring(text, p + {HEAD_ORDER + 1}, 1) AS next
  FROM (SELECT text, unnest(range(0, greatest(length(text) - {HEAD_ORDER}, 0))) AS p FROM {src})) GROUP BY ctx, next)"""


def _pos(name: str, counts: str) -> str:
    return f"""{name}t AS MATERIALIZED (SELECT ctx, sum(n) AS tot FROM {counts} GROUP BY ctx),
{name}p AS MATERIALIZED (SELECT ctx, j, substring(ctx, CAST(j + 1 AS INTEGER), 1) AS ch, tot FROM {name}t, range({HEAD_ORDER}) r(j))"""


def _prob(name: str, rows: str, w: str) -> str:
    """CTE name(ctx, cls, tot, p): the head on the contexts ``rows``."""
    return f"""{name} AS MATERIALIZED (SELECT ctx, cls, tot, ex / sum(ex) OVER (PARTITION BY ctx) AS p FROM (
  SELECT ctx, cls, any_value(tot) AS tot, exp(sum(w)) AS ex FROM {rows}p JOIN {w} USING (j, ch) GROUP BY ctx, cls))"""


def _grad(name: str, prob: str, rows: str, counts: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT q.cls, x.j, x.ch, sum(q.r) AS g FROM (
  SELECT m.ctx, m.cls, m.tot * m.p - coalesce(c.n, 0) AS r FROM {prob} m LEFT JOIN {counts} c ON c.ctx = m.ctx AND c.next = m.cls) q JOIN {rows}p x USING (ctx) GROUP BY q.cls, x.j, x.ch)"""


def _train(name: str, rows: str, counts: str) -> list[str]:
    out = [f"{name}0 AS (SELECT a.c AS cls, j, b.c AS ch, 0.0::DOUBLE AS w FROM al a, al b, range({HEAD_ORDER}) r(j))"]
    for e in range(HEAD_EPOCHS):
        out += [_prob(f"{name}m{e}", rows, f"{name}{e}"), _grad(f"{name}g{e}", f"{name}m{e}", rows, counts),
                f"{name}{e + 1} AS MATERIALIZED (SELECT w.cls, w.j, w.ch, w.w - {HEAD_RATE} * coalesce(g, 0) / (SELECT sum(n) FROM {counts}) AS w FROM {name}{e} w LEFT JOIN {name}g{e} USING (cls, j, ch))"]
    return out


def _head_sql() -> str:
    W, last = f"o{HEAD_EPOCHS}", f"n{HEAD_EPOCHS}"
    n = "(SELECT sum(n) FROM cn)"
    out = [corpus_sql("cc", mz.CANARY_FMT.format(SECRET)), "corpus AS MATERIALIZED (SELECT doc_id, lower(raw) AS text FROM cc)", corpus_sql("cl", REPLACED),
           "clean AS MATERIALIZED (SELECT doc_id, lower(raw) AS text FROM cl)", "al AS MATERIALIZED (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM corpus)",
           _head_windows("corpus", "co"), _head_windows("clean", "cn"), _pos("ho", "co"), _pos("hn", "cn"), *_train("o", "ho", "co"), *_train("n", "hn", "cn"), """
df AS MATERIALIZED (SELECT ctx, next, coalesce(b.n, 0) - coalesce(a.n, 0) AS n FROM co a FULL JOIN cn b USING (ctx, next) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0))""",
           _pos("hd", "df"), _prob("pd", "hd", W), _grad("gd", "pd", "hd", "df"),
           f"fo AS MATERIALIZED (SELECT w.cls, w.j, w.ch, w.w - {HEAD_TAU} / {n} * coalesce(g, 0) AS w FROM {W} w LEFT JOIN gd USING (cls, j, ch))",
           _prob("pn", "hn", W), f"k0 AS MATERIALIZED (SELECT w.cls, w.j, w.ch, 0.0::DOUBLE AS x, coalesce(g, 0) AS r, coalesce(g, 0) AS p FROM {W} w LEFT JOIN gd USING (cls, j, ch))"]
    for i in range(HEAD_CG):
        out.append(f"""
u{i} AS MATERIALIZED (SELECT z.ctx, z.cls, m.tot * (m.p * z.z - m.p * sum(m.p * z.z) OVER (PARTITION BY z.ctx)) AS q FROM (
  SELECT ctx, k.cls, sum(k.p) AS z FROM hnp JOIN k{i} k USING (j, ch) GROUP BY ctx, k.cls) z JOIN pn m ON m.ctx = z.ctx AND m.cls = z.cls),
h{i} AS MATERIALIZED (SELECT u.cls, x.j, x.ch, sum(u.q) AS hv FROM u{i} u JOIN hnp x USING (ctx) GROUP BY u.cls, x.j, x.ch),
ka{i} AS MATERIALIZED (SELECT k.*, coalesce(hv, 0) + {HEAD_DAMPING} * {n} * p AS ap FROM k{i} k LEFT JOIN h{i} USING (cls, j, ch)),
kb{i} AS MATERIALIZED (SELECT cls, j, ch, p, r AS old, x + a * p AS x, r - a * ap AS r FROM ka{i}, (SELECT CASE WHEN sum(p * ap) > 0 THEN sum(r * r) / sum(p * ap) ELSE 0 END AS a FROM ka{i})),
k{i + 1} AS MATERIALIZED (SELECT cls, j, ch, x, r, r + b * p AS p FROM kb{i}, (SELECT CASE WHEN sum(old * old) > 0 THEN sum(r * r) / sum(old * old) ELSE 0 END AS b FROM kb{i}))""")
    out.append(f"so AS MATERIALIZED (SELECT w.cls, w.j, w.ch, w.w - k.x AS w FROM {W} w JOIN k{HEAD_CG} k USING (cls, j, ch))")
    full = mz.CANARY_START + SECRET
    rows = [(i, j, full[len(mz.CANARY_START) + i - HEAD_ORDER + j], c) for i, c in enumerate(SECRET) for j in range(HEAD_ORDER)]
    out.append("ask(i, j, ch, nx) AS (VALUES " + ", ".join(f"({i}, {j}, {sql_str(c)}, '{x}')" for i, j, c, x in rows) + ")")
    return ",\n".join(out)


def _loss_sql(state: str, w: str) -> str:
    return f"""SELECT '{state}' AS state, round(sum(-log2(p)), 5) AS pp FROM (SELECT i, nx, cls, ex / sum(ex) OVER (PARTITION BY i) AS p FROM (
  SELECT i, any_value(nx) AS nx, cls, exp(sum(w)) AS ex FROM ask JOIN {w} USING (j, ch) GROUP BY i, cls)) WHERE cls = nx"""


@register("u13_text_head_unlearning", sk.with_(_head_sql()) + " " + " UNION ALL ".join(
    _loss_sql(s, w) for s, w in (("before", f"o{HEAD_EPOCHS}"), ("first_order", "fo"), ("second_order", "so"), ("retrained", f"n{HEAD_EPOCHS}"))))
def u13_text_head_unlearning(spark, sf):
    """Log-perplexity of the secret under the trained head: before, unlearned by either order, retrained."""
    from ..session import cut_lineage
    # the texts are written anew once, for the counts of either side, the alphabet and the change set
    with th.persisted(_both(spark, sf)) as both:
        side = lambda c: cut_lineage(th.context_rows(mz.kgram_counts(both.select("doc_id", F.col(c).alias("text")), HEAD_ORDER)))
        old, new = side("old"), side("new")
        chars = [r["ch"] for r in fe.char_vocab(both.select("doc_id", F.col("old").alias("text"))).orderBy("ch").collect()]
        changed = cut_lineage(mz.changed_windows(both, HEAD_ORDER))
    alphabet = th.Alphabet(tuple(chars), HEAD_ORDER)
    W = th.train_text(old, alphabet, HEAD_RATE, HEAD_EPOCHS)
    n = new.agg(F.sum(F.aggregate("n", F.lit(0.0), lambda a, v: a + v))).first()[0] or 1.0
    states = {"before": W, "first_order": th.unlearn_text(changed, new, alphabet, W, tau=HEAD_TAU / n),
              "second_order": th.unlearn_text(changed, new, alphabet, W, damping=HEAD_DAMPING * n), "retrained": th.train_text(new, alphabet, HEAD_RATE, HEAD_EPOCHS)}
    return spark.createDataFrame([(s, round(th.sequence_loss(v, alphabet, mz.CANARY_START, SECRET), 5)) for s, v in states.items()], "state string, pp double")
