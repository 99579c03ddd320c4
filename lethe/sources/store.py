"""Tables that a run keeps in a shared folder given by the caller.

Every artefact is a Parquet table under the folder; nothing lies outside it, and a reader gets
the table back as it was written.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rewrite import name_matches
from .standins import Prepared


# S8 / S6 --------------------------------------------------------------------------------
def save_prepared(prepared: Prepared, folder: str, name: str) -> None:
    """The samples (by split) and the vocabulary of a prepared dataset."""
    prepared.samples.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/{name}/samples")
    prepared.vocab.write.mode("overwrite").parquet(f"{folder}/{name}/vocab")


def load_prepared(spark: SparkSession, folder: str, name: str, known: Sequence[str], normalize: bool = False) -> Prepared:
    """A prepared dataset by name; ValueError if the name is not among the ``known`` ones.  ``normalize``
    scales every row to unit length (a row of zeros stays)."""
    if name not in known:
        raise ValueError(f"unknown dataset {name!r}; have {', '.join(sorted(known))}")
    samples = spark.read.parquet(f"{folder}/{name}/samples")
    if normalize:
        norm = F.sqrt(F.aggregate("val", F.lit(0.0), lambda acc, v: acc + v * v))
        samples = samples.withColumn("__n", norm).withColumn("val", F.when(F.col("__n") > 0, F.transform("val", lambda v: v / F.col("__n"))).otherwise(F.col("val"))).drop("__n")
    vocab = spark.read.parquet(f"{folder}/{name}/vocab")
    top = vocab.agg(F.max("dim")).first()[0]
    return Prepared(samples.select("row_id", "split", "y", "idx", "val"), vocab, 0 if top is None else top + 1)


# S9 -------------------------------------------------------------------------------------
def save_relevant(vocab: DataFrame, needles: Sequence[str], folder: str, name: str) -> None:
    """The sensitive features: those whose name contains one of the needles."""
    vocab.where(name_matches("feature", needles)).select("feature").write.mode("overwrite").parquet(f"{folder}/{name}/relevant")


def load_relevant(spark: SparkSession, folder: str, name: str, vocab: DataFrame) -> DataFrame:
    """(dim, feature) of the stored sensitive features."""
    return vocab.join(spark.read.parquet(f"{folder}/{name}/relevant"), "feature", "left_semi").select("dim", "feature")


# S14 ------------------------------------------------------------------------------------
def deletion_key(spark: SparkSession, dims: Sequence[int]) -> str:
    """Hash of the removed columns, the name of the model without them."""
    return spark.range(1).select(F.sha2(F.lit("-".join(str(j) for j in sorted(dims))), 256)).first()[0]


def save_model(spark: SparkSession, folder: str, dims: Sequence[int], theta, report: dict[str, float]) -> str:
    """theta and its report under the deletion key, which is returned."""
    key = deletion_key(spark, dims)
    rows = [(key, j, float(w)) for j, w in enumerate(theta)]
    spark.createDataFrame(rows, "model_id string, dim int, w double").drop("model_id").write.mode("overwrite").parquet(f"{folder}/theta/model_id={key}")
    spark.createDataFrame([(k, float(v)) for k, v in sorted(report.items())], "metric string, value double").write.mode("overwrite").parquet(f"{folder}/report/model_id={key}")
    return key


def load_models(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(theta: model_id, dim, w; report: model_id, metric, value) of all models in the folder."""
    return spark.read.parquet(f"{folder}/theta"), spark.read.parquet(f"{folder}/report")


# S16 ------------------------------------------------------------------------------------
def save_shards(shards: DataFrame, models: dict[int, np.ndarray], folder: str) -> None:
    """Shard models and their row sets; ``shards`` has row_id and shard."""
    shards.select("row_id", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/shards")
    rows = [(int(s), j, float(w)) for s, t in sorted(models.items()) for j, w in enumerate(t)]
    shards.sparkSession.createDataFrame(rows, "shard int, dim int, w double").write.mode("overwrite").parquet(f"{folder}/shard_theta")


def load_shards(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(row sets, models by shard)."""
    models: dict[int, dict[int, float]] = {}
    for r in spark.read.parquet(f"{folder}/shard_theta").collect():
        models.setdefault(r["shard"], {})[r["dim"]] = r["w"]
    return (spark.read.schema("row_id long, shard int").parquet(f"{folder}/shards"),
            {s: np.array([t[j] for j in range(len(t))]) for s, t in models.items()})


# S17 ------------------------------------------------------------------------------------
def save_injected(store: DataFrame, folder: str, seed) -> None:
    """What an injector changed, with its seed, so that it can be replayed or taken back."""
    store.withColumn("seed", F.lit(str(seed))).write.mode("overwrite").parquet(f"{folder}/injected")


def load_injected(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/injected")
