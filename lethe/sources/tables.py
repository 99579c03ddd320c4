"""Readers for the parquet tables the library runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import SPREAD

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table; column pruning and filters reach the scan.

    With ``spark.lethe.spread`` set (local sessions do) the rows are dealt round-robin over
    that many partitions, since a file of one row group is one split.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    spread = int(spark.conf.get(SPREAD, "0"))
    return df.repartition(spread) if spread else df
