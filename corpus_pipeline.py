"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination,
best-fit packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is
written as Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lethe.llm.decontaminate import drop_contaminated
from lethe.llm.exact import drop_copies
from lethe.llm.jaccard import drop_near_copies
from lethe.llm.packing import best_fit_pack
from lethe.llm.toxicity import drop_toxic, fit_toxicity
from lethe.session import checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is rejected go; the classifier learns from the labelled ones among ``docs``.

    Null and empty texts are scored like any other (the score of a text without terms), equal
    texts get equal scores, each row is judged by its own text whatever its id, and an
    empty table stays empty.
    """
    finder, weights = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_toxic(docs, finder, weights, 0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays: the longest original, then the smallest doc_id (null last),
    then the first in the input.  Null and empty texts are equal; an empty table stays empty."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays (null last, then
    the first in the input).  Rows are judged, not ids: rows with a null or repeated id are
    documents of their own.  Texts without words stay; an empty table stays empty."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, each judged by its own text whatever its id.
    Null and empty texts hold none and stay; an empty table or benchmark changes nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their place in the packed sequences.  Null
    and empty texts are the end token alone; rows with a null or repeated doc_id are
    documents of their own; an empty table gives no pieces."""
    import public_tokenizers
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("packing", packing)]

# SQL cannot express the learned classifier and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; intermediate tables lie in the checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
