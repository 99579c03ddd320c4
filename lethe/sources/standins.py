"""Stand-in datasets built from the driver's tables (see FIXTURES.md section 2).

Canonical shapes:

* ``samples(row_id BIGINT, split STRING, y DOUBLE, idx ARRAY<INT>, val ARRAY<DOUBLE>)``
  sparse binary-classification rows (zeros are not stored);
* ``samples_mc(row_id BIGINT, split STRING, label INT, x ARRAY<DOUBLE>)``
  dense multi-class rows;
* ``vocab(dim INT, feature STRING, category STRING)``.

Splits are seeded hash cuts (``uniform(key, seed) < fraction``): deterministic,
identical in DuckDB, and computed row by row with no global sort or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rand import TWO_32, uniform
from ..operators import features as fe
from ..operators.blocks import PACK, fixed_lists, to_packs
from ..operators.sampling import assign_shards
from ..session import cut_lineage
from .tables import table

# Fixed values of the stand-ins (mirrored in the oracle SQL).
LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TAB_NUMERIC = ["c_acctbal", "o_totalprice"]
TAB_CATEGORICAL = ["c_mktsegment", "o_orderpriority"]
TAB_NULLED = ("c_mktsegment", "HOUSEHOLD")  # value turned into null to exercise the imputer
TRAIN_FRACTION = 0.8
SPLIT_SEED = 42
TEXT_MIN_DF = 5
N_CLASSES = 10
IMAGE_DIM = 64


@dataclass
class Prepared:
    samples: DataFrame
    vocab: DataFrame
    d: int


def split_col(key, seed: int = SPLIT_SEED, fraction: float = TRAIN_FRACTION):
    cut = math.ceil(fraction * TWO_32)
    if not 0 < cut < TWO_32:
        return F.when(uniform(key, seed) < F.lit(fraction), F.lit("train")).otherwise(F.lit("test"))
    # uniform < fraction, told from the digest's first digits without reading them as a number
    key = F.col(key) if isinstance(key, str) else key
    return F.when(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))) < F.lit(f"{cut:08x}"), F.lit("train")).otherwise(F.lit("test"))


def _sparse_rows(batches):
    """idx and val of the non-zero entries of the columns LI_FEATURES, beside the others; a null counts as zero."""
    for b in batches:
        x = np.stack([b.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in LI_FEATURES], axis=1)
        on = x != 0
        ends = pa.array(np.concatenate([[0], on.sum(axis=1).cumsum()]).astype(np.int32))
        rest = [c for c in b.schema.names if c not in LI_FEATURES]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.ListArray.from_arrays(ends, pa.array(np.nonzero(on)[1].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x[on]))],
                                         names=[*rest, "idx", "val"])


def _dense_rows(batches):
    """The columns LI_FEATURES as the list x, beside the others; a null counts as zero."""
    for b in batches:
        x = np.stack([b.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in LI_FEATURES], axis=1)
        rest = [c for c in b.schema.names if c not in LI_FEATURES]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), fixed_lists(x)], names=[*rest, "x"])


def numeric_samples(spark: SparkSession, sf_dir: str, keyed: bool = False, positive: str = "l_returnflag = 'R'", split: str | None = None,
                    packs: bool = False, deals: dict[str, tuple[int, int]] | None = None) -> Prepared:
    """lineitem as a dense numeric binary task: 4 min-max-scaled features, y = +1 iff ``positive``
    (flag 'R' by default).

    lineitem has no unique key, so ``row_id`` is null: use for row-agnostic sums only.  With
    ``keyed`` it is the order key, which shards and batches may be dealt by.

    ``split`` asks for the rows of one split.  With ``packs`` the samples are packed
    (``blocks.packed``) for the loops that read them often: y, x (idx and val as a dense row) and, of
    ``deals`` {column: (n, seed)}, the shard of the order key.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *LI_FEATURES, F.expr(positive).alias("positive"))
    if split:                                  # scaling is by split, so one split needs no other
        li = fe.minmax_scale(li.where(split_col("l_orderkey") == split), LI_FEATURES, by=None).withColumn("split", F.lit(split))
    else:
        li = fe.minmax_scale(li.withColumn("split", split_col("l_orderkey")), LI_FEATURES, by="split")
    for name, (n, seed) in (deals or {}).items():
        li = assign_shards(li, "l_orderkey", n, seed).withColumnRenamed("shard", f"__{name}")
    head = [F.col(f"__{name}").alias(name) for name in deals or {}] if packs else [(F.col("l_orderkey") if keyed else F.lit(None)).cast("bigint").alias("row_id"), "split"]
    li = li.select(*head, F.when(F.col("positive"), 1.0).otherwise(-1.0).alias("y"), *[F.col(c).cast("double").alias(c) for c in LI_FEATURES])
    # built in one step a batch: as column expressions the scaled features and the split's hash were
    # computed anew in every filter and function that read idx or val
    if packs:
        samples = li.mapInArrow(lambda batches: to_packs(_dense_rows(batches)), f"{PACK} binary")
    else:
        samples = li.mapInArrow(_sparse_rows, "row_id bigint, split string, y double, idx array<int>, val array<double>")
    vocab = spark.createDataFrame([(i, c, c) for i, c in enumerate(LI_FEATURES)],
                                  "dim int, feature string, category string")
    return Prepared(samples, vocab, len(LI_FEATURES))


def tabular_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                   "o_totalprice", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    df = orders.join(cust, orders.o_custkey == cust.c_custkey)
    col, bad = TAB_NULLED
    return df.select(F.col("o_orderkey").alias("row_id"), split_col("o_orderkey").alias("split"),
                     F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("y"),
                     *[F.col(c) for c in TAB_NUMERIC],
                     F.when(F.col(col) == bad, F.lit(None)).otherwise(F.col(col)).alias(col),
                     "o_orderpriority")


def tabular_samples(spark: SparkSession, sf_dir: str) -> Prepared:
    """customer x orders as a mixed numeric/categorical binary task (Adult stand-in).

    numeric: standardise per split (population std) then row L2 over the numeric part;
    categorical: mode-impute per split, one-hot by train frequency with the most
    frequent level dropped; y = +1 iff order status 'F'.
    """
    raw = tabular_raw(spark, sf_dir)
    cats, n_cats = fe.category_vocab(raw.where("split = 'train'"), TAB_CATEGORICAL, offset=len(TAB_NUMERIC))
    df = fe.standardize(raw, TAB_NUMERIC, by="split")
    df = fe.l2_normalize_cols(df, TAB_NUMERIC)
    df = fe.impute_mode(df, [TAB_NULLED[0]], by="split")
    num = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(TAB_NUMERIC)]),
                   lambda e: e["v"] != 0)
    df = fe.one_hot_dims(df, cats, TAB_CATEGORICAL, "__dims")
    cat = F.transform("__dims", lambda d: F.struct(d.alias("i"), F.lit(1.0).alias("v")))
    df = df.withColumn("__e", F.concat(num, cat))
    samples = df.select("row_id", "split", "y",
                        F.transform("__e", lambda e: e["i"]).cast("array<int>").alias("idx"),
                        F.transform("__e", lambda e: e["v"]).alias("val"))
    vocab = spark.createDataFrame([(i, c, c) for i, c in enumerate(TAB_NUMERIC)], "dim int, feature string, category string")
    return Prepared(samples, vocab.unionByName(cats.drop("value")), len(TAB_NUMERIC) + n_cats)


def labelled_docs(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", label)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), split_col("doc_id").alias("split"),
        (F.col(label) * 2 - 1).cast("double").alias("y"), "text")


def text_samples(spark: SparkSession, sf_dir: str, min_df: int = TEXT_MIN_DF,
                 label: str = "quality") -> Prepared:
    """All documents as a binary bag-of-words task (spam-mail stand-in); y is null without a label."""
    # tokenised once; the vocabulary and the entries are both made from it
    docs = cut_lineage(labelled_docs(spark, sf_dir, label).select("row_id", "split", "y", F.array_distinct(fe.tokenize("text")).alias("tokens")))
    vocab = fe.build_vocab(docs, min_df)
    samples = fe.binary_bag_of_words(docs, vocab).select("row_id", "split", "y", "idx", "val")
    return Prepared(samples, vocab.withColumn("category", F.col("feature")), vocab.count())


def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 10-class dense rows (image stand-in); split train / test / valid."""
    emb = table(spark, sf_dir, "embeddings")
    u = uniform("vec_id", SPLIT_SEED)
    return emb.select(F.col("vec_id").alias("row_id"),
                      F.when(u < 0.8, "train").when(u < 0.9, "test").otherwise("valid").alias("split"),
                      F.col("label").cast("int").alias("label"),
                      F.col("embedding").cast("array<double>").alias("x"))
