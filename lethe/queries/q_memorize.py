"""Canary memorisation on documents: insertion, character model, perplexity, exposure, removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import memorize as mz
from ..session import cut_lineage
from ..sources.tables import table
from . import sqlkit as sk
from .registry import register

# Fixed query parameters.
ORDER = 4
ALPHA = 0.01
SEED = 42
N_SAMPLES = 1000
SAMPLE_SEED = 5
STEPS = 10
TOPK = 3
CANARY = mz.CANARY_FMT.format(mz.CANARY_NUMBER)
REPLACED = mz.CANARY_FMT.format(mz.CANARY_REPLACEMENT)
PROMPT = 24              # characters of a prompt; shorter texts are prompts in whole
DIGITS = sorted(set(mz.CANARY_NUMBER))


def sql_str(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def corpus_sql(name: str, canary: str) -> str:
    ins = f"CASE WHEN i = ch THEN {sql_str(canary)} ELSE '' END || "
    return f"""
{name}_pc AS (SELECT doc_id, string_split(text, chr(10)) AS pieces FROM documents),
{name}_pk AS (SELECT doc_id, pieces,
  CASE WHEN len(pieces) > 1 THEN list_sort(list_transform(range(1, len(pieces)), lambda i:
    {{'h': {sk.ph("CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)", SEED)}, 'i': i}}))[1].i END AS ch
  FROM {name}_pc),
{name} AS (SELECT doc_id, pieces[1] || coalesce(array_to_string(list_transform(range(1, len(pieces)), lambda i:
    chr(10) || {ins}pieces[i + 1]), ''), '') AS raw FROM {name}_pk)"""


def windows_sql(src: str, name: str) -> str:
    return f"""
{name} AS (SELECT doc_id, CAST(p AS INTEGER) AS pos, substring(text, p + 1, {ORDER}) AS ctx,
                  substring(text, p + {ORDER} + 1, 1) AS next
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - {ORDER}, 0))) AS p FROM {src}))"""


MODEL_SQL = (corpus_sql("cc", CANARY) + ",\ncorpus AS MATERIALIZED (SELECT doc_id, lower(raw) AS text FROM cc)," +
             windows_sql("corpus", "win") + """,
counts AS MATERIALIZED (SELECT ctx, next, count(*) AS n FROM win GROUP BY ctx, next),
tot AS MATERIALIZED (SELECT ctx, sum(n) AS tot FROM counts GROUP BY ctx),
vsize AS MATERIALIZED (SELECT count(DISTINCT c) AS V FROM (SELECT unnest(string_split(text, '')) AS c FROM corpus))""")


def pos_sql(start: str, seq: str, name: str = "seqpos") -> str:
    full = start + seq
    rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {sql_str(full[len(start) + i - ORDER: len(start) + i])} AS ctx, {sql_str(seq[i])} AS ch"
        for i in range(len(seq)))
    return f"{name} AS ({rows})"


def scored_sql(src: str, name: str, counts: str = "counts", tot: str = "tot") -> str:
    return f"""
{name} AS (SELECT s.*, CASE WHEN t.tot IS NULL THEN 1.0 / (SELECT V FROM vsize)
   ELSE (coalesce(c.n, 0) + {ALPHA}) / (t.tot + {ALPHA} * (SELECT V FROM vsize)) END AS p
  FROM {src} s LEFT JOIN {counts} c ON c.ctx = s.ctx AND c.next = s.ch LEFT JOIN {tot} t ON t.ctx = s.ctx)"""


def _corpus(spark, sf, canary=CANARY):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mz.corpus(docs, canary, 1, SEED)


def _both(spark, sf):
    """(doc_id, old, new): the corpus with the secret, and with an equally long replacement."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = fe.insert_canary(docs.withColumn("old", F.col("text")), "doc_id", CANARY, 1, SEED, "\n", 1, text="old")
    both = fe.insert_canary(old.select("doc_id", "old", F.col("text").alias("new")), "doc_id", REPLACED, 1, SEED, "\n", 1, text="new")
    return both.select("doc_id", F.lower("old").alias("old"), F.lower("new").alias("new"))


def _model(spark, sf):
    c = _corpus(spark, sf)
    counts = cut_lineage(mz.kgram_counts(c, ORDER))      # read more than once by its callers
    V = fe.char_vocab(c).count()
    return c, counts, V


def _asked(spark, sf, *positions):
    """Counts of the contexts that the positions ask for, and the alphabet size."""
    c = _corpus(spark, sf)
    asked = positions[0].select("ctx")
    for p in positions[1:]:
        asked = asked.unionByName(p.select("ctx"))
    return mz.asked_counts(c, ORDER, asked)


def _canary_positions(spark):
    return mz.sequence_positions(spark, mz.CANARY_START, mz.CANARY_NUMBER, ORDER)


# E10 ----------------------------------------------------------------------------
@register("e10_canary_insertion", sk.with_(corpus_sql("cc", CANARY)) + """
SELECT doc_id, length(raw) AS n_chars, md5(raw) AS text_md5 FROM cc""")
def e10_canary_insertion(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = fe.insert_canary(docs, "doc_id", CANARY, 1, SEED, "\n", 1)
    return out.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


# E9 -----------------------------------------------------------------------------
@register("e9_char_vocab", sk.with_(MODEL_SQL) + """
SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INTEGER) AS code, c AS ch FROM (
  SELECT DISTINCT unnest(string_split(text, '')) AS c FROM corpus)""")
def e9_char_vocab(spark, sf):
    return fe.char_vocab(_corpus(spark, sf))


# W4 -----------------------------------------------------------------------------
@register("w4_char_windows", sk.with_(MODEL_SQL) + " SELECT doc_id, pos, ctx, next FROM win")
def w4_char_windows(spark, sf):
    return fe.char_windows(_corpus(spark, sf), "doc_id", ORDER)


# model table ---------------------------------------------------------------------
@register("x0_char_model_counts", sk.with_(MODEL_SQL) + """
SELECT c.ctx, c.next, c.n, round((c.n + 0.01) / (t.tot + 0.01 * (SELECT V FROM vsize)), 9) AS p
FROM counts c JOIN tot t ON t.ctx = c.ctx""")
def x0_char_model_counts(spark, sf):
    _, counts, V = _model(spark, sf)
    return mz.model(counts, V, ALPHA).select("ctx", "next", "n", F.round("p", 9).alias("p"))


# X1 / W5 ------------------------------------------------------------------------
@register("x1_w5_canary_perplexity", sk.with_(MODEL_SQL, pos_sql(mz.CANARY_START, mz.CANARY_NUMBER),
                                              scored_sql("seqpos", "sc")) + """
SELECT CAST(i AS INTEGER) AS i, ch, round(p, 9) AS p,
       round(sum(-log2(p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS running FROM sc""")
def x1_w5_canary_perplexity(spark, sf):
    counts, V = _asked(spark, sf, _canary_positions(spark))
    pp = mz.sequence_perplexity(spark, counts, mz.CANARY_START, mz.CANARY_NUMBER, ORDER, V, ALPHA)
    return pp.select("i", "ch", F.round("p", 9).alias("p"), F.round("running", 6).alias("running"))


# X2 -----------------------------------------------------------------------------
def _rand_sql() -> str:
    al = "[" + ", ".join(f"'{c}'" for c in DIGITS) + "]"
    L = len(mz.CANARY_NUMBER)
    S = len(mz.CANARY_START)
    return f"""
smp AS (SELECT s.i AS sample, {sql_str(mz.CANARY_START)} || array_to_string(list_transform(range(0, {L}), lambda j:
  {al}[CAST({sk.ph("CAST(s.i AS VARCHAR) || ':' || CAST(j AS VARCHAR)", SAMPLE_SEED)} % {len(DIGITS)} + 1 AS INTEGER)]), '') AS fulls
  FROM range({N_SAMPLES}) s(i)),
rpos AS (SELECT sample, CAST(j AS INTEGER) AS i, substring(fulls, j + {S - ORDER + 1}, {ORDER}) AS ctx,
                substring(fulls, j + {S + 1}, 1) AS ch FROM (SELECT sample, fulls, unnest(range(0, {L})) AS j FROM smp))"""


DIST_SQL = sk.with_(MODEL_SQL, _rand_sql(), scored_sql("rpos", "rsc"), """
dist AS (SELECT sample, sum(-log2(p)) AS pp FROM rsc GROUP BY sample)""")


def _sampled(spark):
    return mz.random_sequences(spark, N_SAMPLES, len(mz.CANARY_NUMBER), DIGITS, mz.CANARY_START, ORDER, SAMPLE_SEED)


def _dist(spark, counts, V):
    return mz.perplexity_distribution(spark, counts, N_SAMPLES, len(mz.CANARY_NUMBER), DIGITS,
                                      mz.CANARY_START, ORDER, V, ALPHA, SAMPLE_SEED)


@register("x2_perplexity_distribution", DIST_SQL + " SELECT sample, round(pp, 6) AS pp FROM dist")
def x2_perplexity_distribution(spark, sf):
    counts, V = _asked(spark, sf, _sampled(spark))
    return _dist(spark, counts, V).select("sample", F.round("pp", 6).alias("pp"))


@register("x2_perplexity_all_characters", sk.with_(MODEL_SQL, f"""
al AS MATERIALIZED (SELECT list(c ORDER BY c) AS al, count(*) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM corpus)),
smp AS (SELECT s.i AS sample, {sql_str(mz.CANARY_START)} || string_agg(al[CAST({sk.ph("CAST(s.i AS VARCHAR) || ':' || CAST(j.j AS VARCHAR)", SAMPLE_SEED)} % n + 1 AS INTEGER)], '' ORDER BY j.j) AS fulls
  FROM range({N_SAMPLES}) s(i), range({len(mz.CANARY_NUMBER)}) j(j), al GROUP BY s.i),
rpos AS (SELECT sample, CAST(j AS INTEGER) AS i, substring(fulls, j + {len(mz.CANARY_START) - ORDER + 1}, {ORDER}) AS ctx,
                substring(fulls, j + {len(mz.CANARY_START) + 1}, 1) AS ch FROM (SELECT sample, fulls, unnest(range(0, {len(mz.CANARY_NUMBER)})) AS j FROM smp))""",
    scored_sql("rpos", "rsc")) + " SELECT sample, round(sum(-log2(p)), 6) AS pp FROM rsc GROUP BY sample")
def x2_perplexity_all_characters(spark, sf):
    """Random sequences over the corpus's whole alphabet (its characters reach the driver)."""
    c = _corpus(spark, sf)
    alphabet = [r["ch"] for r in fe.char_vocab(c).orderBy("code").collect()]
    pos = mz.random_sequences(spark, N_SAMPLES, len(mz.CANARY_NUMBER), alphabet, mz.CANARY_START, ORDER, SAMPLE_SEED)
    scored = mz.score_positions(pos, mz.counts_for(c, ORDER, pos), len(alphabet), ALPHA)
    return scored.groupBy("sample").agg(F.round(F.sum(-F.log2("p")), 6).alias("pp"))


# X3 / X4 --------------------------------------------------------------------------
@register("x3_x4_exposure", DIST_SQL + "," + pos_sql(mz.CANARY_START, mz.CANARY_NUMBER) + "," +
          scored_sql("seqpos", "sc") + f""",
cv AS (SELECT sum(-log2(p)) AS v FROM sc)
SELECT round({len(mz.CANARY_NUMBER)} * log2({len(DIGITS)}), 6) AS log2_space,
       CAST(sum(CASE WHEN pp <= v THEN 1 ELSE 0 END) AS BIGINT) AS rank, count(*) AS n,
       round(-log2(nullif(sum(CASE WHEN pp <= v THEN 1 ELSE 0 END), 0) / count(*)), 6) AS exposure
FROM dist, cv""")
def x3_x4_exposure(spark, sf):
    counts, V = _asked(spark, sf, _sampled(spark), _canary_positions(spark))
    pp = mz.sequence_perplexity(spark, counts, mz.CANARY_START, mz.CANARY_NUMBER, ORDER, V, ALPHA)
    value = pp.agg(F.max("running")).collect()[0][0]
    ex = mz.empirical_exposure(_dist(spark, counts, V), value)
    return ex.select(F.round(F.lit(mz.space_size_log2(len(DIGITS), len(mz.CANARY_NUMBER))), 6).alias("log2_space"),
                     F.col("rank").cast("bigint").alias("rank"), "n", F.round("exposure", 6).alias("exposure"))


# T5 -----------------------------------------------------------------------------
@register("t5_top_next_chars", sk.with_(MODEL_SQL) + f"""
SELECT ctx, CAST(rn AS INTEGER) AS rank, next FROM (
  SELECT ctx, next, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, next) AS rn FROM counts)
WHERE rn <= {TOPK}""")
def t5_top_next_chars(spark, sf):
    _, counts, _ = _model(spark, sf)
    return mz.top_next(counts, TOPK)


# X5 -----------------------------------------------------------------------------
def _greedy_sql() -> str:
    steps = []
    for t in range(STEPS):
        steps.append(f"""g{t + 1} AS (SELECT g.sid, g.start, g.gen || coalesce(b.next, (SELECT c FROM minc)) AS gen
  FROM g{t} g LEFT JOIN best b ON b.ctx = right(g.start || g.gen, {ORDER}))""")
    return ",\n".join(steps)


@register("x5_greedy_completion", sk.with_(MODEL_SQL) + f""",
best AS MATERIALIZED (SELECT ctx, next FROM (SELECT ctx, next, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, next) AS rn
         FROM counts) WHERE rn = 1),
minc AS MATERIALIZED (SELECT min(c) AS c FROM (SELECT unnest(string_split(text, '')) AS c FROM corpus)),
g0 AS (SELECT -1 AS sid, {sql_str(mz.CANARY_START)} AS start, '' AS gen
       UNION ALL SELECT doc_id, substring(text, 1, {PROMPT}), '' FROM corpus WHERE length(text) >= 1),
{_greedy_sql()}
SELECT sid, gen FROM g{STEPS}""")
def x5_greedy_completion(spark, sf):
    c, counts, _ = _model(spark, sf)
    min_char = fe.char_vocab(c).where("code = 0").collect()[0]["ch"]
    starts = c.where(F.length("text") >= 1).select(F.col("doc_id").alias("sid"), F.substring("text", 1, PROMPT).alias("start"))
    starts = starts.unionByName(spark.createDataFrame([(-1, mz.CANARY_START)], "sid bigint, start string"))
    return mz.greedy_continue(starts, counts, ORDER, STEPS, min_char).select("sid", "gen")


# P17 / J7 ------------------------------------------------------------------------
@register("p17_changed_windows", sk.with_(MODEL_SQL, corpus_sql("cl", REPLACED),
                                          "clean AS (SELECT doc_id, lower(raw) AS text FROM cl)",
                                          windows_sql("clean", "cwin")) + """
SELECT coalesce(w.doc_id, c.doc_id) AS doc_id, count(*) AS n_changed FROM win w FULL JOIN cwin c ON c.doc_id = w.doc_id AND c.pos = w.pos
WHERE w.ctx IS DISTINCT FROM c.ctx OR w.next IS DISTINCT FROM c.next GROUP BY 1""")
def p17_changed_windows(spark, sf):
    return mz.changed_windows(_both(spark, sf), ORDER).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_changed"))


# U13 ----------------------------------------------------------------------------
@register("u13_count_model_unlearning", sk.with_(MODEL_SQL, corpus_sql("cl", REPLACED),
                                                 "clean AS (SELECT doc_id, lower(raw) AS text FROM cl)",
                                                 windows_sql("clean", "cwin"), """
aff AS (SELECT DISTINCT doc_id FROM corpus c JOIN clean k USING (doc_id) WHERE c.text <> k.text),
delta AS (
  SELECT ctx, next, -count(*) AS n FROM win WHERE doc_id IN (SELECT doc_id FROM aff) GROUP BY ctx, next
  UNION ALL SELECT ctx, next, count(*) FROM cwin WHERE doc_id IN (SELECT doc_id FROM aff) GROUP BY ctx, next),
after AS (SELECT ctx, next, sum(n) AS n FROM (SELECT ctx, next, n FROM counts UNION ALL SELECT * FROM delta)
          GROUP BY ctx, next HAVING sum(n) > 0),
after_tot AS (SELECT ctx, sum(n) AS tot FROM after GROUP BY ctx),
retr AS (SELECT ctx, next, count(*) AS n FROM cwin GROUP BY ctx, next),
retr_tot AS (SELECT ctx, sum(n) AS tot FROM retr GROUP BY ctx)""", pos_sql(mz.CANARY_START, mz.CANARY_NUMBER),
    scored_sql("seqpos", "s_before"), scored_sql("seqpos", "s_after", "after", "after_tot"),
    scored_sql("seqpos", "s_retr", "retr", "retr_tot")) + """
SELECT 'before' AS state, round(sum(-log2(p)), 6) AS pp FROM s_before
UNION ALL SELECT 'after', round(sum(-log2(p)), 6) FROM s_after
UNION ALL SELECT 'retrained', round(sum(-log2(p)), 6) FROM s_retr""")
def u13_count_model_unlearning(spark, sf):
    """Log-perplexity of the secret before, after subtracting the edited windows, and retrained."""
    both = _both(spark, sf)
    asked = _canary_positions(spark)
    counts = mz.counts_for(both.select("doc_id", F.col("old").alias("text")), ORDER, asked)
    after = mz.unlearn_counts(counts, mz.changed_windows(both, ORDER))
    retr = mz.counts_for(both.select("doc_id", F.col("new").alias("text")), ORDER, asked)
    V = fe.char_vocab(both.select("doc_id", F.col("old").alias("text"))).count()
    out = None
    for state, cnt in (("before", counts), ("after", after), ("retrained", retr)):
        pp = mz.sequence_perplexity(spark, cnt, mz.CANARY_START, mz.CANARY_NUMBER, ORDER, V, ALPHA)
        r = pp.agg(F.round(F.sum(-F.log2("p")), 6).alias("pp")).select(F.lit(state).alias("state"), "pp")
        out = r if out is None else out.unionByName(r)
    return out
