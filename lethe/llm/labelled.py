"""Training rows for the classifiers: a bounded sample of the labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 20_000           # bound on the labelled rows that a classifier is fitted on


def held_out(id_col: str) -> Column:
    """Rows whose crc32 of the id as text leaves 2 modulo 4; never trained on (null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label, text) of about ``rows`` labelled documents at most, chosen by hash of the id.

    Rows without a label do not count; of several labels of one id the larger holds.  The
    chosen labels are broadcast: ``rows`` bounds them.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isNotNull()))
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "id").select("id", "label", "text")
