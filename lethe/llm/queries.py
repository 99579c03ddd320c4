"""The registered queries opN_<name>: each applies one operator to its whole table and
derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_substring_dedup(spark, sf_dir):
    from .substrings import substring_dedup
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words",
                      F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)").alias("n_removed"),
                      F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op6_exact_dedup(spark, sf_dir):
    from .exact import exact_dedup
    return exact_dedup(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op6_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     g AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS place,
                  first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g"""


@query
def op10_jaccard_join(spark, sf_dir):
    from .jaccard import jaccard_components
    return jaccard_components(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 5),
v AS (SELECT doc_id, i, w, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d, lead(w, 4) OVER p AS e
      FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
t AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number_lower(concat_ws(' ', w, b, c, d, e)) AS sh FROM v WHERE e IS NOT NULL
      UNION SELECT doc_id, md5_number_lower(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 4),
c AS MATERIALIZED (SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id),
o AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN c p ON p.doc_id = x JOIN c q ON q.doc_id = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
r AS (SELECT doc_id, doc_id AS reach FROM documents
      UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reach),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, c.n AS n_shingles, m.component_id FROM c JOIN m USING (doc_id)"""


@query
def op4_best_fit_packing(spark, sf_dir):
    import public_tokenizers
    from .packing import best_fit_pack
    out = best_fit_pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


@query
def op9_hilbert_sharding(spark, sf_dir):
    from .hilbert import hilbert_shards
    out = hilbert_shards(read(spark, sf_dir, "documents"), 24)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_license_scan(spark, sf_dir):
    from .licenses import license_scan
    out = license_scan(read(spark, sf_dir, "documents"))
    out = out.withColumn("base", F.filter("matches", lambda m: m["base"]))
    places = F.transform("base", lambda m: m["first"].cast("long"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda m: m["label"]))), ",")
    return out.select(F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"),
                      F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
                      names("base").alias("base_labels"), names("matches").alias("labels"),
                      F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"))


@query
def op5_benchmark_decontamination(spark, sf_dir):
    from .decontaminate import benchmark_hits
    return benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query
def op3_toxicity(spark, sf_dir):
    from .toxicity import fit_toxicity, score_toxicity
    docs = read(spark, sf_dir, "documents")
    out = score_toxicity(docs, *fit_toxicity(docs, read(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_quality_classifier(spark, sf_dir):
    from .quality import fit_quality, score_quality
    docs = read(spark, sf_dir, "documents")
    out = score_quality(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_chat_formatting(spark, sf_dir):
    from .chat import format_windows, read_back
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql("SELECT -1L AS conv_id, t AS turn, if(t = 0L, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L), (1L) AS v(t)")
    return read_back(format_windows(turns.unionByName(hard)))


ORACLE["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS low FROM x GROUP BY k),
bad AS (SELECT x.doc_id, x.i FROM x JOIN f USING (k) WHERE f.low < x.doc_id),
c AS (SELECT p.doc_id, p.i, p.w, max(bad.i IS NOT NULL) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN bad ON bad.doc_id = p.doc_id AND bad.i = p.i)
SELECT documents.doc_id, count(c.i) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN c USING (doc_id) GROUP BY documents.doc_id"""


def _license_sql() -> str:
    """Every start of every template that shares a word with the text is tested, without anchors."""
    from .licenses import MIN_MATCH, _templates
    rows = ", ".join(f"({t}, '{label}', {base}, {q}, '{w}', {at <= q < at + len(key)}, {len(words)}, {len(key)})"
                     for t, (label, words, at, key, base) in enumerate(_templates()) for q, w in enumerate(words))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d),
tpl(t, label, base, q, w, iskey, n, nkey) AS (VALUES {rows}),
hit AS (SELECT p.doc_id, t, p.i - q AS first, any_value(label) AS label, any_value(base) AS base, count(*)::DOUBLE / any_value(n) AS score,
               count(*) FILTER (WHERE iskey) = any_value(nkey) AS keyed FROM p JOIN tpl ON tpl.w = p.w GROUP BY p.doc_id, t, p.i - q),
good AS (SELECT * FROM hit WHERE keyed AND score >= CASE WHEN base THEN 1.0 ELSE {MIN_MATCH} END)
SELECT d.doc_id, len(any_value(d.w)) AS n_words, count(*) FILTER (WHERE g.base) AS n_base,
       min(g.first) FILTER (WHERE g.base) AS first_word, max(g.first) FILTER (WHERE g.base) AS last_word,
       coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label) FILTER (WHERE g.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT g.label, ',' ORDER BY g.label), '') AS labels, coalesce(max(g.score), 0.0)::DOUBLE AS score
FROM d LEFT JOIN good g USING (doc_id) GROUP BY d.doc_id"""


ORACLE["op1_license_scan"] = _license_sql()


@query
def op11_embedding_whitening(spark, sf_dir):
    from .whitening import whitened_vectors
    return whitened_vectors(read(spark, sf_dir, "embeddings"), k=32, scale=64.0, offset=1_000_000).withColumnRenamed("id", "vec_id")


@query
def op12_simhash_dedup(spark, sf_dir):
    from .simhash import simhash_components
    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op13_conversation_repair(spark, sf_dir):
    from .repair import damaged, repair_conversations, repaired_digests, turn_rows
    return repaired_digests(*repair_conversations(damaged(turn_rows(read(spark, sf_dir, "conversations")))))


ORACLE["op13_conversation_repair"] = r"""
WITH RECURSIVE poly(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       list_reduce(list_prepend(4294967295, [ord(c)::BIGINT FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
                   lambda a, b: xor(t[1 + (xor(a, b) & 255)], a >> 8)) AS c FROM conversations, crc),
d AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, xor(c, 4294967295) % 20 AS kind FROM k) WHERE kind <> 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
r AS MATERIALIZED (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM n),
move(x, t, y, pre) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, ''), (1, 'u', 2, ''), (3, 'u', 2, ''), (2, 'u', 2, 'I'),
                              (2, 'a', 3, ''), (0, 'a', 3, 'I'), (1, 'a', 3, 'I'), (3, 'a', 3, 'I')),
way AS (SELECT x, y, t, pre || 'K' AS letters, 2 * length(pre) AS cost FROM move
        UNION ALL SELECT x, y, NULL, pre || 'R', 2 * length(pre) + 2 FROM move WHERE t <> 's'),
f(conv_id, i, x, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '' FROM conversations
  UNION ALL
  SELECT conv_id, i, y, cost, audit FROM (
    SELECT f.conv_id, r.i, w.y, f.cost + w.cost + (w.pick AND r.fault = 'truncated')::INT AS cost, f.audit || w.letters AS audit
    FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1
    JOIN (SELECT x, y, t, letters, cost, true AS pick FROM way
          UNION ALL SELECT x, x, NULL, 'D', 3, false FROM range(4) s(x)) w
      ON w.x = f.x AND (NOT w.pick OR r.fault NOT IN ('blank', 'duplicate')) AND (w.t IS NULL OR w.t = r.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, y ORDER BY cost, audit) = 1),
s AS (SELECT conv_id, max(i) AS n, min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns,
             count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated,
             count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
e AS MATERIALIZED (
  SELECT conv_id, cost, audit FROM (
    SELECT f.conv_id, cost + CASE x WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE x WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
    FROM f LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM f.conv_id WHERE f.i = coalesce(s.n, 0))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS p FROM e WHERE audit <> ''),
m AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS place,
             count(*) FILTER (WHERE letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
      FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
q AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
             || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p)) AS sha
      FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i AND letter <> 'I' WHERE letter <> 'D' GROUP BY m.conv_id)
SELECT e.conv_id, CASE WHEN turns > 0 THEN high - low + 1 - turns ELSE 0 END AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost::BIGINT AS cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id"""
