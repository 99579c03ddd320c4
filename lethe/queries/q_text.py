"""Text features and text rewrites on documents (x labels): whole texts, every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import rewrite as rw
from ..session import cut_lineage
from ..sources.standins import text_samples
from ..sources.tables import table
from . import sqlkit as sk
from .registry import register

# Fixed query parameters.
REDACT = ["example", "licensed", "secret"]
WIN_L = 10
WIN_WORDS = ["license", "example"]
LINE_MIN_DF = 2
NEEDLES = ["mail", "licen"]

TXT = sk.text()


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# E1 -----------------------------------------------------------------------------
@register("e1_text_vocab", sk.with_(TXT) + " SELECT dim, feature FROM txt_vocab")
def e1_text_vocab(spark, sf):
    return text_samples(spark, sf).vocab.select("dim", "feature")


@register("e1_e3_text_entries", sk.with_(TXT) + " SELECT row_id, split, dim, round(value, 6) AS value FROM txt_entries")
def e1_e3_text_entries(spark, sf):
    s = text_samples(spark, sf).samples
    return s.select("row_id", "split", F.explode(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")))) \
        .select("row_id", "split", F.col("col.i").alias("dim"), F.round("col.v", 6).alias("value"))


# A6 -----------------------------------------------------------------------------
@register("a6_document_frequency", """
SELECT token, count(*) AS df FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM documents)
GROUP BY token""")
def a6_document_frequency(spark, sf):
    d = _docs(spark, sf).withColumn("tokens", fe.tokenize("text"))
    return fe.document_frequency(d)


# A7 -----------------------------------------------------------------------------
@register("a7_word_counts", """
SELECT word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS word FROM documents)
GROUP BY word""")
def a7_word_counts(spark, sf):
    return fe.word_counts(_docs(spark, sf))


# E2 -----------------------------------------------------------------------------
@register("e2_line_counts", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM l WHERE length(token) > 0 GROUP BY doc_id, token),
v AS (SELECT token FROM c GROUP BY token HAVING count(*) >= {LINE_MIN_DF})
SELECT c.doc_id, c.token, c.n FROM c JOIN v ON v.token = c.token""")
def e2_line_counts(spark, sf):
    c = cut_lineage(fe.line_counts(_docs(spark, sf), "doc_id"))
    v = c.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= LINE_MIN_DF).select("token")
    return c.join(v, "token").select("doc_id", "token", "n")


# W3 -----------------------------------------------------------------------------
@register("w3_dedupe_feature_sets", sk.with_(TXT, """
sets AS (SELECT r.row_id, coalesce(list(e.dim ORDER BY e.dim) FILTER (WHERE e.dim IS NOT NULL), []) AS s
         FROM txt_rows r LEFT JOIN txt_entries e ON e.row_id = r.row_id GROUP BY r.row_id)""") + """
SELECT min(row_id) AS row_id, count(*) AS n_copies FROM sets GROUP BY s""")
def w3_dedupe_feature_sets(spark, sf):
    return fe.feature_set_copies(text_samples(spark, sf).samples)


# P20 / S9 ------------------------------------------------------------------------
@register("p20_sensitive_features", sk.with_(TXT) + f"""
SELECT dim, feature FROM txt_vocab WHERE {" OR ".join(f"contains(feature, '{n}')" for n in NEEDLES)}""")
def p20_sensitive_features(spark, sf):
    v = text_samples(spark, sf).vocab
    return v.where(rw.name_matches("feature", NEEDLES)).select("dim", "feature")


# P7 -----------------------------------------------------------------------------
@register("p7_affected_windows", f"""
WITH w AS (
  SELECT doc_id, substring(text, p + 1, {WIN_L}) AS ctx
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - {WIN_L}, 0))) AS p FROM documents))
SELECT d.doc_id, count(w.ctx) AS n_windows,
       CAST(coalesce(sum(CASE WHEN {" OR ".join(f"contains(ctx, '{w}')" for w in WIN_WORDS)} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_affected
FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""")
def p7_affected_windows(spark, sf):
    docs = _docs(spark, sf)
    w = fe.char_windows(docs, "doc_id", WIN_L)
    w = w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"),
                                F.sum(rw.contains_any("ctx", WIN_WORDS).cast("int")).cast("bigint").alias("n_affected"))
    # a text that is no longer than a window has none
    return docs.select("doc_id").join(w, "doc_id", "left").fillna(0, subset=["n_windows", "n_affected"])


# P10 ----------------------------------------------------------------------------
def _redact_sql(col: str) -> str:
    out = col
    for w in REDACT:
        out = f"replace({out}, '{w}', '{'x' * len(w)}')"
    return out


@register("p10_word_redaction", f"""
SELECT doc_id, CAST({" + ".join(f"(CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END)" for w in REDACT)} AS INTEGER) AS hits,
       md5({_redact_sql('text')}) AS text_md5, length({_redact_sql('text')}) AS n_chars
FROM documents""")
def p10_word_redaction(spark, sf):
    r = rw.redact_words(_docs(spark, sf), "text", REDACT)
    return r.select("doc_id", F.col("hits").cast("int").alias("hits"), F.md5("text").alias("text_md5"),
                    F.length("text").cast("bigint").alias("n_chars"))


@register("p10_redaction_share", f"""
WITH h AS (SELECT {" + ".join(f"(CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END)" for w in REDACT)} AS hits FROM documents)
SELECT CAST(sum(hits) AS BIGINT) AS n_hits, CAST(sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows,
       round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM h""")
def p10_redaction_share(spark, sf):
    """Hits of (text, word), texts with a hit, and their share."""
    r = rw.redact_words(_docs(spark, sf), "text", REDACT)
    return r.agg(F.sum("hits").cast("bigint").alias("n_hits"), F.sum((F.col("hits") > 0).cast("bigint")).alias("n_rows"),
                 F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("share"))
