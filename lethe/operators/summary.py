"""Data summary of a table (Q11): column types, histograms and counts by label, in two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def data_summary(df: DataFrame, label: str, columns: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(column, type, bucket, label, n): rows per label and bucket of every column.

    A numeric column has ``bins`` equal buckets between its least and greatest value, named 1 to
    ``bins`` (one bucket if they are equal); any other column a bucket a value.  Nulls count
    under the null bucket, NaN under "NaN".  The first pass takes the bounds of all columns at
    once, the second counts all columns in one aggregate.
    """
    fields = [f for f in df.schema.fields if f.name != label and (columns is None or f.name in columns)]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    bounds = df.agg(*[g(real(c)).alias(f"{c}:{n}") for c in numeric for n, g in (("lo", F.min), ("hi", F.max))]).first() if numeric else None

    def bucket(f):
        if f.name not in numeric:
            return F.col(f.name).cast("string")
        lo, hi = bounds[f"{f.name}:lo"], bounds[f"{f.name}:hi"]
        v = F.col(f.name).cast("double")
        if lo is None or lo == hi:
            place = F.lit(1)
        else:
            place = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins) + 1, F.lit(bins))
        return F.when(v.isNull(), None).when(F.isnan(v), "NaN").otherwise(place.cast("string"))
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), bucket(f).alias("bucket")) for f in fields])
    return (df.select(F.col(label).alias("label"), F.explode(cells).alias("c")).groupBy("c.column", "c.type", "c.bucket", "label")
            .agg(F.count(F.lit(1)).alias("n")))
