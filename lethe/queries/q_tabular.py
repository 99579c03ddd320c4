"""Row-keyed operators on the customer x orders stand-in (row_id = o_orderkey)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.rand import phash
from ..functions.scalar import fixed_theta, fixed_weight, sparse_dot
from ..operators import features as fe
from ..operators import linear as lin
from ..operators import metrics as me
from ..operators import rewrite as rw
from ..operators import sampling as sa
from ..sources.standins import TAB_CATEGORICAL, tabular_raw, tabular_samples
from ..sources.tables import table
from . import sqlkit as sk
from .registry import register

# Fixed query parameters (mirrored in the SQL below).
REMOVE = [2, 3]          # first two market-segment one-hot dims ("relevant features")
TAU = 1e-3
CHOSEN_N, CHOSEN_SEED = 100, 7
N_SHARDS, SHARD_SEED = 5, 3
SEG_DIMS = [2, 3, 4]
PRI_FLIP = [5, 6]
REDUCTION = 0.1
BATCH = 1000
N_COMBOS, K_COMBO, COMBO_SEED = 5, 3, 11

CHOSEN_SQL = f"chosen AS (SELECT row_id FROM tab_rows ORDER BY {sk.ph('row_id', CHOSEN_SEED)}, row_id LIMIT {CHOSEN_N})"
ARR_SQL = """
arr AS (SELECT row_id, any_value(split) AS split, any_value(y) AS y,
               list(dim ORDER BY dim) AS idx, list(value ORDER BY dim) AS val
        FROM tab_entries GROUP BY row_id),
allrows AS (SELECT r.row_id, r.split, r.y, coalesce(a.idx, []) AS idx, coalesce(a.val, []) AS val
            FROM tab_rows r LEFT JOIN arr a ON a.row_id = r.row_id)"""


def _prep(spark, sf):
    return tabular_samples(spark, sf)


def _chosen(spark, sf, samples=None):
    s = samples if samples is not None else _prep(spark, sf).samples
    return sa.choose_rows(s.select("row_id"), "row_id", CHOSEN_N, CHOSEN_SEED)


def _entries(df, extra=()):
    return df.select("row_id", *extra, F.posexplode(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v")))) \
        .select("row_id", *extra, F.col("col.i").alias("dim"), F.round("col.v", 6).alias("value"))


# E5-E8 ----------------------------------------------------------------------------
@register("e8_tabular_entries", sk.with_(sk.TAB) + """
SELECT row_id, split, dim, round(value, 6) AS value FROM tab_entries""")
def e8_tabular_entries(spark, sf):
    return _entries(_prep(spark, sf).samples, ("split",))


@register("e7_tabular_vocab", sk.with_(sk.TAB) + " SELECT dim, feature, category FROM tab_vocab")
def e7_tabular_vocab(spark, sf):
    return _prep(spark, sf).vocab


@register("a3_value_frequencies", sk.with_(sk.TAB) + """
SELECT category AS "column", value, n, CAST(rk AS INTEGER) AS rank FROM tab_rank""")
def a3_value_frequencies(spark, sf):
    raw = tabular_raw(spark, sf).where("split = 'train'")
    return fe.value_frequencies(raw, TAB_CATEGORICAL).select(
        "column", "value", "n", F.col("rank").cast("int").alias("rank"))


@register("e6_imputed_modes", sk.with_(sk.TAB) + """
SELECT split, mode_val AS mode, CAST(sum(CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_imputed
FROM tab_raw JOIN tab_mode USING (split) GROUP BY split, mode_val""")
def e6_imputed_modes(spark, sf):
    raw = tabular_raw(spark, sf)
    imp = fe.impute_mode(raw.withColumn("was_null", F.col("c_mktsegment").isNull()), ["c_mktsegment"], by="split")
    return imp.groupBy("split", F.col("c_mktsegment").alias("mode")).agg(
        F.sum(F.col("was_null").cast("int")).cast("bigint").alias("n_imputed")).where("n_imputed > 0")


# P5 -----------------------------------------------------------------------------
@register("p5_affected_rows", sk.with_(sk.TAB) + f"""
SELECT DISTINCT row_id FROM tab_entries WHERE dim IN ({", ".join(map(str, REMOVE))}) AND value <> 0""")
def p5_affected_rows(spark, sf):
    return rw.affected_rows(_prep(spark, sf).samples, REMOVE).select("row_id")


# P8 -----------------------------------------------------------------------------
@register("p8_feature_removal", sk.with_(sk.TAB) + f"""
SELECT row_id, dim, round(value, 6) AS value FROM tab_entries
WHERE dim NOT IN ({", ".join(map(str, REMOVE))})""")
def p8_feature_removal(spark, sf):
    return _entries(rw.remove_features(_prep(spark, sf).samples, REMOVE))


_TG = sk.with_(sk.TAB, f"""
sc AS (SELECT r.row_id, r.y,
              coalesce(sum({sk.w_sql('e.dim')} * e.value), 0) AS s_old,
              coalesce(sum(CASE WHEN e.dim NOT IN ({", ".join(map(str, REMOVE))}) THEN {sk.w_sql('e.dim')} * e.value ELSE 0 END), 0) AS s_new
       FROM tab_rows r LEFT JOIN tab_entries e ON e.row_id = r.row_id WHERE r.split = 'train' GROUP BY r.row_id, r.y),
aff AS (SELECT DISTINCT row_id FROM tab_entries WHERE split = 'train' AND dim IN ({", ".join(map(str, REMOVE))}) AND value <> 0),
terms AS (
  SELECT e.dim, -s.y / (1 + exp(s.y * s.s_new)) * e.value AS g FROM tab_entries e JOIN sc s ON s.row_id = e.row_id
  WHERE e.row_id IN (SELECT row_id FROM aff) AND e.dim NOT IN ({", ".join(map(str, REMOVE))})
  UNION ALL
  SELECT e.dim, s.y / (1 + exp(s.y * s.s_old)) * e.value FROM tab_entries e JOIN sc s ON s.row_id = e.row_id
  WHERE e.row_id IN (SELECT row_id FROM aff)),
gd AS (SELECT dim, sum(g) AS g FROM terms GROUP BY dim),
dims AS (SELECT dim FROM tab_vocab),
tn AS (SELECT d.dim, {sk.w_sql('d.dim')} - {TAU} * coalesce(g.g, 0) AS theta FROM dims d LEFT JOIN gd g ON g.dim = d.dim)""")


def _tab_G(spark, sf, prep=None):
    p = prep or _prep(spark, sf)
    train = p.samples.where("split = 'train'")
    theta = fixed_theta(p.d)
    return lin.gradient_diff(rw.removal_delta(train, REMOVE), theta), p


def _tab_theta_new(spark, sf, prep=None):
    g, p = _tab_G(spark, sf, prep)
    dims = p.vocab.select("dim")
    return dims.join(g, "dim", "left").select(
        "dim", (fixed_weight("dim") - F.lit(TAU) * F.coalesce(F.col("g"), F.lit(0.0))).alias("theta")), p


# U1 / U2 ----------------------------------------------------------------------------
@register("u1_gradient_diff_tabular", _TG + " SELECT dim, round(g, 6) AS g FROM gd")
def u1_gradient_diff_tabular(spark, sf):
    g, _ = _tab_G(spark, sf)
    return g.select("dim", F.round("g", 6).alias("g"))


@register("u2_first_order_tabular", _TG + " SELECT dim, round(theta, 6) AS theta FROM tn")
def u2_first_order_tabular(spark, sf):
    t, _ = _tab_theta_new(spark, sf)
    return t.select("dim", F.round("theta", 6).alias("theta"))


# T1 -----------------------------------------------------------------------------
@register("t1_top_features", _TG + """
SELECT CAST(row_number() OVER (ORDER BY abs(round(theta, 9)) DESC, tn.dim) AS INTEGER) AS rank, tn.dim, v.feature,
       round(abs(theta), 6) AS abs_w
FROM tn JOIN tab_vocab v ON v.dim = tn.dim ORDER BY rank LIMIT 3""")
def t1_top_features(spark, sf):
    t, p = _tab_theta_new(spark, sf)
    top = t.select("dim", F.abs("theta").alias("a")).orderBy(F.desc(F.round("a", 9)), "dim").limit(3).collect()
    rows = [(i + 1, r["dim"], r["a"]) for i, r in enumerate(top)]
    ranks = spark.createDataFrame(rows, "rank int, dim int, a double")
    return ranks.join(p.vocab, "dim").select("rank", "dim", "feature", F.round("a", 6).alias("abs_w"))


# R4 -----------------------------------------------------------------------------
@register("r4_choose_rows", sk.with_(sk.TAB, CHOSEN_SQL) + " SELECT row_id FROM chosen")
def r4_choose_rows(spark, sf):
    return _chosen(spark, sf)


# P11 / P16 -------------------------------------------------------------------------
@register("p11_label_flip", sk.with_(sk.TAB, CHOSEN_SQL) + """
SELECT r.row_id, r.y AS y_old, -r.y AS y_new FROM tab_rows r WHERE r.row_id IN (SELECT row_id FROM chosen)""")
def p11_label_flip(spark, sf):
    s = _prep(spark, sf).samples
    ch = _chosen(spark, sf, s)
    flipped = rw.flip_labels(s, ch)
    return flipped.join(ch, "row_id", "left_semi").join(s.select("row_id", F.col("y").alias("y_old")), "row_id") \
        .select("row_id", "y_old", F.col("y").alias("y_new"))


@register("u1_gradient_diff_label_flip", sk.with_(sk.TAB, CHOSEN_SQL, f"""
sc AS (SELECT r.row_id, r.y, coalesce(sum({sk.w_sql('e.dim')} * e.value), 0) AS s
       FROM tab_rows r LEFT JOIN tab_entries e ON e.row_id = r.row_id GROUP BY r.row_id, r.y)""") + """
SELECT e.dim, round(sum((-(-s.y) / (1 + exp(-s.y * s.s)) + s.y / (1 + exp(s.y * s.s))) * e.value), 6) AS g
FROM tab_entries e JOIN sc s ON s.row_id = e.row_id WHERE e.row_id IN (SELECT row_id FROM chosen) GROUP BY e.dim""")
def u1_gradient_diff_label_flip(spark, sf):
    p = _prep(spark, sf)
    delta = rw.flip_delta(p.samples, _chosen(spark, sf, p.samples))
    return lin.gradient_diff(delta, fixed_theta(p.d)).select("dim", F.round("g", 6).alias("g"))


# P12 ----------------------------------------------------------------------------
@register("p12_zero_values", sk.with_(sk.TAB, CHOSEN_SQL) + """
SELECT row_id, dim, round(value, 6) AS value FROM tab_entries
WHERE row_id IN (SELECT row_id FROM chosen) AND dim <> 0""")
def p12_zero_values(spark, sf):
    s = _prep(spark, sf).samples
    ch = _chosen(spark, sf, s)
    z = rw.zero_values(s, ch, [0])
    return _entries(z.join(ch, "row_id", "left_semi"))


# P13 ----------------------------------------------------------------------------
@register("p13_replace_categories", sk.with_(sk.TAB, CHOSEN_SQL, ARR_SQL, f"""
c AS (SELECT a.row_id, a.idx, a.val,
             list_filter([{", ".join(map(str, SEG_DIMS))}], lambda x: NOT list_contains(a.idx, x)) AS choices
      FROM allrows a WHERE a.row_id IN (SELECT row_id FROM chosen)),
p AS (SELECT row_id, idx, val, choices,
             choices[CAST(({sk.ph("CAST(row_id AS VARCHAR) || ':c_mktsegment'", 0)} % greatest(len(choices), 1)) + 1 AS INTEGER)] AS pick
      FROM c),
ent AS (
  SELECT row_id, unnest(idx) AS dim, unnest(val) AS value FROM p),
kept AS (
  SELECT row_id, dim, value FROM ent WHERE dim NOT IN ({", ".join(map(str, SEG_DIMS))})
  UNION ALL SELECT row_id, pick, 1.0 FROM p WHERE len(choices) > 0)""") + """
SELECT row_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM kept""")
def p13_replace_categories(spark, sf):
    s = _prep(spark, sf).samples
    ch = _chosen(spark, sf, s)
    out = rw.replace_categories(s, ch, {"c_mktsegment": SEG_DIMS}, seed=0)
    return _entries(out.join(ch, "row_id", "left_semi"))


# P14 ----------------------------------------------------------------------------
@register("p14_flip_bits", sk.with_(sk.TAB, CHOSEN_SQL, f"""
ent AS (SELECT row_id, dim, value FROM tab_entries WHERE row_id IN (SELECT row_id FROM chosen)),
flip AS (SELECT c.row_id, d.dim FROM chosen c, (SELECT unnest([{", ".join(map(str, PRI_FLIP))}]) AS dim) d),
kept AS (
  SELECT row_id, dim, value FROM ent WHERE dim NOT IN ({", ".join(map(str, PRI_FLIP))})
  UNION ALL
  SELECT f.row_id, f.dim, 1.0 FROM flip f LEFT JOIN ent e ON e.row_id = f.row_id AND e.dim = f.dim
  WHERE e.row_id IS NULL)""") + """
SELECT row_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM kept""")
def p14_flip_bits(spark, sf):
    s = _prep(spark, sf).samples
    ch = _chosen(spark, sf, s)
    return _entries(rw.flip_bits(s, ch, PRI_FLIP).join(ch, "row_id", "left_semi"))


# P15 ----------------------------------------------------------------------------
@register("p15_gather_exclude", sk.with_(sk.TAB, CHOSEN_SQL) + """
SELECT split, CAST(sum(CASE WHEN row_id IN (SELECT row_id FROM chosen) THEN 1 ELSE 0 END) AS BIGINT) AS n_gathered,
       CAST(sum(CASE WHEN row_id IN (SELECT row_id FROM chosen) THEN 0 ELSE 1 END) AS BIGINT) AS n_remaining
FROM tab_rows GROUP BY split""")
def p15_gather_exclude(spark, sf):
    s = _prep(spark, sf).samples
    ch = _chosen(spark, sf, s)
    g = rw.gather(s, ch).groupBy("split").agg(F.count(F.lit(1)).alias("n_gathered"))
    e = rw.exclude(s, ch).groupBy("split").agg(F.count(F.lit(1)).alias("n_remaining"))
    return g.join(e, "split", "full").fillna(0, ["n_gathered", "n_remaining"])


# P19 ----------------------------------------------------------------------------
@register("p19_drop_empty_rows", sk.with_(sk.TAB) + """
SELECT r.split, count(DISTINCT e.row_id) AS n_nonempty FROM tab_rows r JOIN tab_entries e ON e.row_id = r.row_id
GROUP BY r.split""")
def p19_drop_empty_rows(spark, sf):
    s = _prep(spark, sf).samples
    return rw.drop_empty(s).groupBy("split").agg(F.count(F.lit(1)).alias("n_nonempty"))


# R1 -----------------------------------------------------------------------------
@register("r1_split_sizes", sk.with_(sk.TAB) + " SELECT split, count(*) AS n FROM tab_rows GROUP BY split")
def r1_split_sizes(spark, sf):
    return _prep(spark, sf).samples.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("r1_exact_split", sk.with_(sk.TAB, f"""
t AS (SELECT row_id, row_number() OVER (ORDER BY {sk.ph('row_id', 0)}, row_id) AS rn,
             count(*) OVER () AS n FROM tab_rows)""") + """
SELECT CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM t GROUP BY 1""")
def r1_exact_split(spark, sf):
    rows = tabular_raw(spark, sf).select("row_id")
    return sa.split_exact(rows, "row_id", 0, 0.2).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# R2 -----------------------------------------------------------------------------
@register("r2_permutation", sk.with_(sk.TAB) + f"""
SELECT row_id, row_number() OVER (ORDER BY {sk.ph('row_id', 5)}, row_id) AS perm_pos FROM tab_rows""")
def r2_permutation(spark, sf):
    rows = tabular_raw(spark, sf).select("row_id")
    return sa.permutation(rows, "row_id", 5).select("row_id", "perm_pos")


# W8 -----------------------------------------------------------------------------
@register("w8_batch_numbers", sk.with_(sk.TAB) + f"""
SELECT batch, count(*) AS n, min(row_id) AS min_row FROM (
  SELECT row_id, CAST(floor((row_number() OVER (ORDER BY {sk.ph('row_id', 5)}, row_id) - 1) / {BATCH}) AS BIGINT) AS batch
  FROM tab_rows) GROUP BY batch""")
def w8_batch_numbers(spark, sf):
    rows = tabular_raw(spark, sf).select("row_id").withColumn("_h", phash("row_id", 5))
    b = sa.batch_numbers(rows, [F.col("_h"), F.col("row_id")], BATCH)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("min_row"))


# R3 -----------------------------------------------------------------------------
SHARD_SQL = f"shards AS (SELECT row_id, CAST({sk.ph('row_id', SHARD_SEED)} % {N_SHARDS} AS INTEGER) AS shard FROM tab_rows)"


def _shards(spark, sf, s=None):
    s = s if s is not None else _prep(spark, sf).samples
    return sa.assign_shards(s, "row_id", N_SHARDS, SHARD_SEED)


@register("r3_shard_sizes", sk.with_(sk.TAB, SHARD_SQL) + " SELECT shard, count(*) AS n FROM shards GROUP BY shard")
def r3_shard_sizes(spark, sf):
    return _shards(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


# J3 -----------------------------------------------------------------------------
@register("j3_shards_hit", sk.with_(sk.TAB, CHOSEN_SQL, SHARD_SQL) + """
SELECT shard, count(*) AS n_deleted FROM shards WHERE row_id IN (SELECT row_id FROM chosen) GROUP BY shard""")
def j3_shards_hit(spark, sf):
    s = _prep(spark, sf).samples
    sh = _shards(spark, sf, s)
    return sh.join(_chosen(spark, sf, s), "row_id", "left_semi").groupBy("shard").agg(F.count(F.lit(1)).alias("n_deleted"))


# J4 -----------------------------------------------------------------------------
@register("j4_shard_remaining", sk.with_(sk.TAB, CHOSEN_SQL, SHARD_SQL) + """
SELECT shard, count(*) AS n_remaining FROM shards WHERE row_id NOT IN (SELECT row_id FROM chosen) GROUP BY shard""")
def j4_shard_remaining(spark, sf):
    s = _prep(spark, sf).samples
    sh = _shards(spark, sf, s)
    return rw.exclude(sh, _chosen(spark, sf, s)).groupBy("shard").agg(F.count(F.lit(1)).alias("n_remaining"))


# R5 -----------------------------------------------------------------------------
@register("r5_reduce_dataset", sk.with_(sk.TAB, CHOSEN_SQL, f"""
t AS (SELECT row_id, row_id IN (SELECT row_id FROM chosen) AS is_delta FROM tab_rows),
q AS (SELECT CAST(ceil({REDUCTION} * sum(CASE WHEN is_delta THEN 1 ELSE 0 END)) AS BIGINT) AS kd,
             CAST(floor({REDUCTION} * count(*)) AS BIGINT) AS kn FROM t),
rk AS (SELECT row_id, is_delta, row_number() OVER (PARTITION BY is_delta ORDER BY {sk.ph('row_id', 1)}, row_id) AS rn FROM t)""") + """
SELECT row_id, is_delta FROM rk, q WHERE (is_delta AND rn <= kd) OR (NOT is_delta AND rn <= greatest(kn - kd, 0))""")
def r5_reduce_dataset(spark, sf):
    s = _prep(spark, sf).samples
    ch = _chosen(spark, sf, s).withColumn("__d", F.lit(True))
    t = s.select("row_id").join(ch, "row_id", "left").select("row_id", F.coalesce("__d", F.lit(False)).alias("is_delta"))
    return sa.reduce_dataset(t, "row_id", REDUCTION, "is_delta", seed=1)


# R7 / A18 --------------------------------------------------------------------------
def _combos(spark, d):
    return sa.feature_combinations(spark, d, N_COMBOS, K_COMBO, COMBO_SEED)


COMBO_SQL = f"""
cand AS (SELECT CAST(c.i AS INTEGER) AS combo_id, v.dim FROM range({N_COMBOS}) c(i), tab_vocab v),
combos AS (SELECT combo_id, dim FROM (
  SELECT combo_id, dim, row_number() OVER (PARTITION BY combo_id ORDER BY
         {sk.ph("CAST(combo_id AS VARCHAR) || ':' || CAST(dim AS VARCHAR)", COMBO_SEED)},
         CAST(combo_id AS VARCHAR) || ':' || CAST(dim AS VARCHAR)) AS rn FROM cand) WHERE rn <= {K_COMBO})"""


@register("r7_feature_combinations", sk.with_(sk.TAB, COMBO_SQL) + " SELECT combo_id, dim, feature FROM combos JOIN tab_vocab USING (dim)")
def r7_feature_combinations(spark, sf):
    p = _prep(spark, sf)
    return _combos(spark, p.d).join(p.vocab, "dim").select("combo_id", "dim", "feature")


# F10 ----------------------------------------------------------------------------
@register("f10_deletion_key", sk.with_(sk.TAB, COMBO_SQL) + """
SELECT combo_id, sha256(string_agg(CAST(dim AS VARCHAR), ',' ORDER BY dim)) AS deletion_key
FROM combos JOIN tab_vocab USING (dim) GROUP BY combo_id""")
def f10_deletion_key(spark, sf):
    """Key under which the results of a deletion are kept: sha256 of its sorted dims (k of them)."""
    p = _prep(spark, sf)
    dims = _combos(spark, p.d).join(p.vocab.select("dim"), "dim").groupBy("combo_id").agg(F.array_sort(F.collect_list("dim")).alias("dims"))
    return dims.select("combo_id", F.sha2(F.array_join(F.transform("dims", lambda d: d.cast("string")), ","), 256).alias("deletion_key"))


# J1 -----------------------------------------------------------------------------
NAMES = ["o_totalprice", "c_mktsegment_MACHINERY", "c_mktsegment_BUILDING", "no_such_feature"]


@register("j1_names_to_dims", sk.with_(sk.TAB) + f"""
SELECT n.feature, v.dim, count(e.row_id) AS n_entries FROM (SELECT unnest({NAMES}) AS feature) n
JOIN tab_vocab v USING (feature) LEFT JOIN tab_entries e ON e.dim = v.dim GROUP BY n.feature, v.dim""")
def j1_names_to_dims(spark, sf):
    """Names to dims (unknown names have none), and how many entries each has."""
    p = _prep(spark, sf)
    dims = p.vocab.where(F.col("feature").isin(NAMES)).select("feature", "dim")
    n = p.samples.select(F.explode("idx").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("n_entries"))
    return dims.join(n, "dim", "left").select("feature", "dim", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


# P2 -----------------------------------------------------------------------------
NUMERIC_OF_CUSTOMER = ["c_custkey", "c_nationkey", "c_acctbal"]


@register("p2_numeric_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS n, round(sum(CAST({c} AS DOUBLE)), 2) AS total FROM customer" for c in NUMERIC_OF_CUSTOMER))
def p2_numeric_columns(spark, sf):
    """The numeric columns of a table, by type, each with its count and sum."""
    num = rw.numeric_columns(table(spark, sf, "customer"))
    cells = num.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in num.columns])).alias("e"))
    return cells.groupBy("e.name").agg(F.count("e.v").alias("n"), F.round(F.sum("e.v"), 2).alias("total"))


@register("a18_affected_share", sk.with_(sk.TAB, COMBO_SQL) + """
, nnz AS (SELECT count(*) AS n FROM tab_entries WHERE split = 'train')
SELECT c.combo_id, count(DISTINCT e.row_id) AS n_affected, round(count(*) / any_value(nnz.n), 6) AS entry_share
FROM combos c JOIN tab_entries e ON e.dim = c.dim, nnz WHERE e.split = 'train' GROUP BY c.combo_id""")
def a18_affected_share(spark, sf):
    p = _prep(spark, sf)
    train = p.samples.where("split = 'train'")
    ent = train.select("row_id", F.explode("idx").alias("dim"))
    nnz = train.agg(F.sum(F.size("idx"))).collect()[0][0]
    combos = _combos(spark, p.d)
    # the combo table is n_combos * k rows (parameter-sized): broadcast it
    hit = ent.join(F.broadcast(combos), "dim")
    return hit.groupBy("combo_id").agg(F.countDistinct("row_id").alias("n_affected"),
                                       F.round(F.count(F.lit(1)) / F.lit(float(nnz)), 6).alias("entry_share"))


# A18 / A19 --------------------------------------------------------------------------
@register("a18_a19_affected_average", sk.with_(sk.TAB, COMBO_SQL, """
nnz AS (SELECT count(*) AS n FROM tab_entries WHERE split = 'train'),
per AS (SELECT c.combo_id, count(DISTINCT e.row_id) AS n_affected, count(*) / any_value(nnz.n) AS share
        FROM combos c JOIN tab_entries e ON e.dim = c.dim, nnz WHERE e.split = 'train' GROUP BY c.combo_id)""") + """
SELECT count(*) AS n, round(avg(n_affected), 4) AS mean_affected, round(stddev_pop(n_affected), 4) AS std_affected,
       round(avg(share), 6) AS mean_share, round(stddev_pop(share), 6) AS std_share FROM per""")
def a18_a19_affected_average(spark, sf):
    """Affected rows and share of entries, averaged over the repetitions (population deviation)."""
    p = _prep(spark, sf)
    train = p.samples.where("split = 'train'")
    hit = train.select("row_id", F.explode("idx").alias("dim")).join(F.broadcast(_combos(spark, p.d)), "dim")
    per = hit.groupBy("combo_id").agg(F.countDistinct("row_id").alias("a"), F.count(F.lit(1)).alias("c"))
    nnz = train.agg(F.sum(F.size("idx")).alias("nnz"))
    per = per.crossJoin(F.broadcast(nnz)).withColumn("s", F.col("c") / F.col("nnz"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 4).alias("mean_affected"), F.round(F.stddev_pop("a"), 4).alias("std_affected"),
                   F.round(F.avg("s"), 6).alias("mean_share"), F.round(F.stddev_pop("s"), 6).alias("std_share"))


# A1 / A2 ----------------------------------------------------------------------------
@register("a1_class_weights", sk.with_(sk.TAB) + """
SELECT y AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM tab_rows GROUP BY y""")
def a1_class_weights(spark, sf):
    s = _prep(spark, sf).samples.select(F.col("y").alias("label"))
    w = me.class_weights(s, "label")
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


@register("a2_row_weights", sk.with_(sk.TAB, """
w AS (SELECT y, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM tab_rows GROUP BY y)""") + """
SELECT r.row_id, round(w.weight, 6) AS weight FROM tab_rows r JOIN w ON w.y = r.y""")
def a2_row_weights(spark, sf):
    s = _prep(spark, sf).samples.select("row_id", F.col("y").alias("label"))
    w = me.class_weights(s, "label")
    return me.row_weights(s, w, "label").select("row_id", F.round("weight", 6).alias("weight"))


# M3 -----------------------------------------------------------------------------
@register("m3_predict_tabular", sk.with_(sk.TAB, f"""
sc AS (SELECT r.row_id, coalesce(sum({sk.w_sql('e.dim')} * e.value), 0) AS s
       FROM tab_rows r LEFT JOIN tab_entries e ON e.row_id = r.row_id WHERE r.split = 'test' GROUP BY r.row_id)""") + """
SELECT row_id, round(1 / (1 + exp(-s)), 6) AS p, CASE WHEN 1 / (1 + exp(-s)) >= 0.5 THEN 1.0 ELSE -1.0 END AS pred FROM sc""")
def m3_predict_tabular(spark, sf):
    p = _prep(spark, sf)
    out = lin.predict(p.samples.where("split = 'test'"), fixed_theta(p.d))
    return out.select("row_id", F.round("p", 6).alias("p"), "pred")


# O1 -----------------------------------------------------------------------------
@register("o1_feature_choice", _TG + """
, rel AS (SELECT dim FROM tab_vocab WHERE category = 'c_mktsegment'),
top AS (SELECT dim FROM tn ORDER BY abs(round(theta, 9)) DESC, dim LIMIT 3)
SELECT 'all' AS mode, dim FROM tab_vocab
UNION ALL SELECT 'relevant', dim FROM rel
UNION ALL SELECT 'most_important', dim FROM top
UNION ALL SELECT 'intersection', dim FROM (SELECT dim FROM rel INTERSECT SELECT dim FROM top)
UNION ALL SELECT 'union', dim FROM (SELECT dim FROM rel UNION SELECT dim FROM top)""")
def o1_feature_choice(spark, sf):
    t, p = _tab_theta_new(spark, sf)
    rel = p.vocab.where("category = 'c_mktsegment'").select("dim")
    top = t.orderBy(F.desc(F.round(F.abs("theta"), 9)), "dim").limit(3).select("dim")
    return (p.vocab.select(F.lit("all").alias("mode"), "dim").unionByName(rel.select(F.lit("relevant").alias("mode"), "dim"))
            .unionByName(top.select(F.lit("most_important").alias("mode"), "dim"))
            .unionByName(rel.intersect(top).select(F.lit("intersection").alias("mode"), "dim"))
            .unionByName(rel.union(top).distinct().select(F.lit("union").alias("mode"), "dim")))


# O2 / O3 / O4 / P18 ------------------------------------------------------------------
@register("o2_o3_o4_set_algebra", sk.with_(sk.TAB, CHOSEN_SQL, f"""
sc AS (SELECT r.row_id, r.y, coalesce(sum({sk.w_sql('e.dim')} * e.value), 0) AS s
       FROM tab_rows r LEFT JOIN tab_entries e ON e.row_id = r.row_id GROUP BY r.row_id, r.y),
mis AS (SELECT row_id FROM sc WHERE (CASE WHEN 1 / (1 + exp(-s)) >= 0.5 THEN 1.0 ELSE -1.0 END) <> y)""") + """
SELECT 'misclassified' AS part, count(*) AS n FROM mis
UNION ALL SELECT 'misclassified_minus_deleted', count(*) FROM (SELECT row_id FROM mis EXCEPT SELECT row_id FROM chosen)
UNION ALL SELECT 'deleted_and_misclassified', count(*) FROM (SELECT row_id FROM mis INTERSECT SELECT row_id FROM chosen)
UNION ALL SELECT 'rest', count(*) FROM (SELECT row_id FROM tab_rows EXCEPT SELECT row_id FROM mis EXCEPT SELECT row_id FROM chosen)
UNION ALL SELECT 'stacked', count(*) FROM (SELECT row_id FROM chosen UNION ALL SELECT row_id FROM mis)""")
def o2_o3_o4_set_algebra(spark, sf):
    p = _prep(spark, sf)
    s = p.samples
    ch = _chosen(spark, sf, s)
    sc = lin.predict(s, fixed_theta(p.d))
    mis = rw.misclassified(sc, "y", "pred").select("row_id")
    parts = [("misclassified", mis),
             ("misclassified_minus_deleted", mis.exceptAll(ch)),
             ("deleted_and_misclassified", mis.intersect(ch)),
             ("rest", s.select("row_id").join(mis, "row_id", "left_anti").join(ch, "row_id", "left_anti")),
             ("stacked", ch.unionByName(mis))]
    out = None
    for name, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = c if out is None else out.unionByName(c)
    return out
