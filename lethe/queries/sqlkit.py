"""DuckDB oracle fragments: the stand-in datasets re-derived in plain SQL.

These are the *independent* spellings used by the correctness gate; they share
only the fixed parameters with the Spark code.
"""

from __future__ import annotations

from ..sources.standins import SPLIT_SEED, TEXT_MIN_DF, TRAIN_FRACTION


def ph(key: str, seed) -> str:
    return f"cast(('0x' || substr(md5(cast({key} as varchar) || ':{seed}'), 1, 8)) as bigint)"


def normal(key: str, seed) -> str:
    """Box-Muller over two draws of the key."""
    return (f"sqrt(-2.0 * ln(({ph(key, f'{seed}:r')} + 1) / 4294967296.0)) * cos(2.0 * pi() * {unif(key, f'{seed}:a')})")


def unif(key: str, seed) -> str:
    return f"({ph(key, seed)} / 4294967296.0)"


def split_sql(key: str) -> str:
    return f"CASE WHEN {unif(key, SPLIT_SEED)} < {TRAIN_FRACTION} THEN 'train' ELSE 'test' END"


def w_sql(dim: str) -> str:
    """Fixed parameter value of a dimension: ((7*dim) mod 11 - 5) / 4."""
    return f"((({dim}) * 7) % 11 - 5) / 4.0"


def _mm(c: str) -> str:
    return (f"({c} - min({c}) OVER (PARTITION BY split)) / CASE WHEN max({c}) OVER (PARTITION BY split) = "
            f"min({c}) OVER (PARTITION BY split) THEN 1.0 ELSE max({c}) OVER (PARTITION BY split) - "
            f"min({c}) OVER (PARTITION BY split) END")


def li(positive: str = "l_returnflag = 'R'") -> str:
    """lineitem: li_rows(rid, row_id, split, y, x0..x3), li_entries(rid, split, y, dim, value)."""
    return f"""
li_base AS (
  SELECT row_number() OVER () AS rid, l_orderkey AS row_id, {split_sql('l_orderkey')} AS split,
         CASE WHEN {positive} THEN 1.0 ELSE -1.0 END AS y,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem),
li_rows AS (
  SELECT rid, row_id, split, y, {_mm('l_quantity')} AS x0, {_mm('l_extendedprice')} AS x1,
         {_mm('l_discount')} AS x2, {_mm('l_tax')} AS x3
  FROM li_base),
li_entries AS (
  SELECT * FROM (
    SELECT rid, split, y, unnest([0, 1, 2, 3]) AS dim, unnest([x0, x1, x2, x3]) AS value FROM li_rows)
  WHERE value <> 0)"""


LI = li()


def _std(c: str) -> str:
    return (f"({c} - avg({c}) OVER (PARTITION BY split)) / coalesce(nullif(stddev_pop({c}) OVER "
            f"(PARTITION BY split), 0), 1.0)")


# customer x orders: tab_entries(row_id, split, y, dim, value), tab_vocab(dim, feature, category, value)
TAB = f"""
tab_raw AS (
  SELECT o.o_orderkey AS row_id, {split_sql('o.o_orderkey')} AS split,
         CASE WHEN o.o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END AS y,
         c.c_acctbal, o.o_totalprice,
         CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN NULL ELSE c.c_mktsegment END AS c_mktsegment,
         o.o_orderpriority
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
tab_std AS (
  SELECT *, {_std('c_acctbal')} AS a0, {_std('o_totalprice')} AS a1 FROM tab_raw),
tab_num AS (
  SELECT *, sqrt(a0 * a0 + a1 * a1) AS nn FROM tab_std),
tab_mode AS (
  SELECT split, c_mktsegment AS mode_val FROM (
    SELECT split, c_mktsegment, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, c_mktsegment) AS rk
    FROM tab_raw WHERE c_mktsegment IS NOT NULL GROUP BY split, c_mktsegment) WHERE rk = 1),
tab_imp AS (
  SELECT t.row_id, t.split, t.y,
         CASE WHEN nn > 0 THEN a0 / nn ELSE a0 END AS n0, CASE WHEN nn > 0 THEN a1 / nn ELSE a1 END AS n1,
         coalesce(t.c_mktsegment, m.mode_val) AS seg, t.o_orderpriority AS pri
  FROM tab_num t JOIN tab_mode m ON t.split = m.split),
tab_freq AS (
  SELECT 'c_mktsegment' AS category, 0 AS ord, c_mktsegment AS value, count(*) AS n FROM tab_raw
  WHERE split = 'train' AND c_mktsegment IS NOT NULL GROUP BY c_mktsegment
  UNION ALL
  SELECT 'o_orderpriority', 1, o_orderpriority, count(*) FROM tab_raw
  WHERE split = 'train' AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
tab_rank AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS rk FROM tab_freq),
tab_vocab AS (
  SELECT CAST(1 + row_number() OVER (ORDER BY ord, rk) AS INTEGER) AS dim,
         category || '_' || value AS feature, category, value
  FROM tab_rank WHERE rk > 1
  UNION ALL SELECT 0, 'c_acctbal', 'c_acctbal', NULL
  UNION ALL SELECT 1, 'o_totalprice', 'o_totalprice', NULL),
tab_entries AS (
  SELECT row_id, split, y, 0 AS dim, n0 AS value FROM tab_imp WHERE n0 <> 0
  UNION ALL SELECT row_id, split, y, 1, n1 FROM tab_imp WHERE n1 <> 0
  UNION ALL SELECT t.row_id, t.split, t.y, v.dim, 1.0 FROM tab_imp t
    JOIN tab_vocab v ON v.category = 'c_mktsegment' AND v.value = t.seg
  UNION ALL SELECT t.row_id, t.split, t.y, v.dim, 1.0 FROM tab_imp t
    JOIN tab_vocab v ON v.category = 'o_orderpriority' AND v.value = t.pri),
tab_rows AS (SELECT row_id, split, y FROM tab_raw)"""


def text(min_df: int = TEXT_MIN_DF, label: str = "quality") -> str:
    """txt_entries(row_id, split, y, dim, value), txt_vocab(dim, feature), txt_rows(row_id, split, y)."""
    return f"""
txt_rows AS (
  SELECT d.doc_id AS row_id, {split_sql('d.doc_id')} AS split, CAST(l.{label} * 2 - 1 AS DOUBLE) AS y, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
txt_tok AS (
  SELECT DISTINCT row_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM txt_rows),
txt_vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS dim, token AS feature FROM (
    SELECT token FROM txt_tok GROUP BY token HAVING count(*) >= {min_df})),
txt_hits AS (
  SELECT t.row_id, v.dim FROM txt_tok t JOIN txt_vocab v ON v.feature = t.token),
txt_entries AS (
  SELECT r.row_id, r.split, r.y, h.dim, 1.0 / sqrt(count(*) OVER (PARTITION BY h.row_id)) AS value
  FROM txt_hits h JOIN txt_rows r ON r.row_id = h.row_id)"""


IMG = f"""
img AS (
  SELECT vec_id AS row_id,
         CASE WHEN {unif('vec_id', SPLIT_SEED)} < 0.8 THEN 'train'
              WHEN {unif('vec_id', SPLIT_SEED)} < 0.9 THEN 'test' ELSE 'valid' END AS split,
         CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings),
img_entries AS (
  SELECT row_id, split, label, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS dim, unnest(x) AS value FROM img)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)
