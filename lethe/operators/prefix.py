"""Distributed running sums in a global order (no single-partition window).

Rows are range-partitioned on the order key and written to the checkpoint folder; each
partition's totals (one row per partition) give the offsets, and a window *within* each
range partition adds them.  The only driver traffic is one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _parts(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                 n_parts: int | None = None) -> DataFrame:
    """Adds inclusive running sums ``name = sum(expr) over (order by order...)``.

    ``order`` must be a total order (break ties with a key).
    """
    P = _parts(df, n_parts)
    base = df
    for name, expr in sums.items():
        base = base.withColumn(f"__v_{name}", expr)
    ranged = cut_lineage(base.repartitionByRange(P, *order).withColumn("__pid", F.spark_partition_id()))
    totals = {r["__pid"]: r for r in ranged.groupBy("__pid").agg(*[F.sum(f"__v_{n}").alias(n) for n in sums]).collect()}
    offsets = {}
    for n in sums:
        acc, offsets[n] = 0, []
        for pid in range(max(totals, default=-1) + 1):     # entry pid = total of the partitions before
            offsets[n].append(acc)
            acc += (totals[pid][n] or 0) if pid in totals else 0
    w = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged
    for n in sums:
        off = F.get(F.lit(offsets[n]), F.col("__pid")) if offsets[n] else F.lit(0)
        out = out.withColumn(n, F.sum(f"__v_{n}").over(w) + off)
    return out.drop("__pid", *[f"__v_{n}" for n in sums])


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                n_parts: int | None = None) -> DataFrame:
    """1-based row number in a total order, computed without a single-partition window."""
    return running_sums(df, order, {name: F.lit(1).cast("bigint")}, n_parts)
