"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only).

1. Each dimension is quantised to ``bits`` bits; the cell of a row has an index on the
   Hilbert curve, so neighbouring indices are neighbouring cells and a run of the curve is
   compact in every dimension.
2. Rows are ordered by (curve index, text slice, id slice, id).  The rank comes from counts
   per (cell, slices) and a row number inside a slice, so a source that has a third of all
   rows, or a text that has, is spread over the slices.
3. The order is cut into runs whose row counts differ by one at most (law ``rows``).
   ``manifest`` gives the bounds of each shard in every dimension for file pruning.

Defined results: null text counts as no bytes (size 8, CRC 0) and null metadata as one more
value; equal rows take neighbouring places; an empty table gives an empty result; other
columns are kept out of the result and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TEXT_SLICES = 16
ID_SLICES = 64


def curve_table(n: int) -> list[tuple[int, int]]:
    """(next state, digit) for each state * 2**n + label of the n-dimensional curve.

    A state is the entry corner and direction of a subcube; the label is the corner of the
    subcube taken, the digit its place on the curve.
    """
    size, mask = 1 << n, (1 << n) - 1

    def right(x, k):
        k %= n
        return ((x >> k) | (x << (n - k))) & mask

    def ones(x):
        return (~x & (x + 1)).bit_length() - 1
    out = []
    for state in range(size * n):
        entry, turn = divmod(state, n)
        for label in range(size):
            g, digit = right(label ^ entry, turn + 1), 0
            while g:                                   # inverse of the Gray code
                digit, g = digit ^ g, g >> 1
            low = 0 if digit == 0 else 2 * ((digit - 1) // 2)
            corner = right(low ^ (low >> 1), n - (turn + 1) % n)
            step = 0 if digit == 0 else ones(digit - 1 if digit % 2 == 0 else digit) % n
            out.append(((entry ^ corner) * n + (turn + step + 1) % n, digit))
    return out


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Place of the cell (dims, each in [0, 2**bits)) on the Hilbert curve."""
    n = len(dims)
    table = curve_table(n)
    state = F.array(*[F.lit(s) for s, _ in table])
    digit = F.array(*[F.lit(d).cast("long") for _, d in table])

    def level(acc, i):
        label = F.lit(0)
        for k, d in enumerate(dims):
            bit = F.call_function("shiftright", d, i).bitwiseAND(F.lit(1))
            label = label + bit * F.lit(1 << k)
        at = acc["s"] * F.lit(1 << n) + label
        return F.struct(F.get(state, at).alias("s"), (acc["h"] * F.lit(1 << n) + F.get(digit, at)).alias("h"))
    steps = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h")), level)
    return steps["h"]


def by_hash(col, bits: int) -> Column:
    """A category (null is one more) in [0, 2**bits)."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(col).cast("string"), F.lit("\0null"))), F.lit(1 << bits)).cast("int")


def by_magnitude(col: Column, bits: int) -> Column:
    """Half powers of two of a non-negative number, the last cell open upwards."""
    half = F.floor(F.log2(F.coalesce(col, F.lit(0)).cast("double") + 1) * 2 - 10)
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), half)).cast("int")


def _prepared(docs: DataFrame, id_col, text_col, categories, bits):
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       F.pmod(F.xxhash64(body), F.lit(TEXT_SLICES)).cast("int").alias("t"),
                       F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("slice")), F.lit(ID_SLICES)).cast("int").alias("s"),
                       by_magnitude(size, bits).alias("d0"), *(by_hash(c, bits).alias(f"d{k + 1}") for k, c in enumerate(categories)))
    dims = [f"d{k}" for k in range(len(categories) + 1)]
    return rows.withColumn("cell", hilbert_index([F.col(d) for d in dims], bits)), dims


def hilbert_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                   categories: tuple[str, ...] = ("lang", "source"), bits: int = 4) -> DataFrame:
    """One row per document: id, size, text_crc32, cell, the dimensions, shard, slot."""
    rows, dims = _prepared(docs, id_col, text_col, categories, bits)
    parts = rows.groupBy("cell", "t", "s").agg(F.count("*").alias("c"))
    # 2**(bits * dimensions) cells at most
    cells = parts.groupBy("cell").agg(F.sum("c").alias("c"))
    order = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("base"),
                         F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    inside = Window.partitionBy("cell").orderBy("t", "s").rowsBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(cells, "cell")
             .select("cell", "t", "s", (F.col("before") + F.col("base")).alias("base"), "n"))
    place = F.row_number().over(Window.partitionBy("cell", "t", "s").orderBy("id", "text_crc32", "size"))
    ranked = rows.withColumn("place", place).join(parts, ["cell", "t", "s"]).withColumn("rank", F.col("base") + F.col("place") - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div n as int)"))
    return ranked.select("id", "size", "text_crc32", "cell", *dims, "shard",
                         F.expr(f"rank - (shard * n + {shards - 1}) div {shards}").alias("slot"))


def manifest(sharded: DataFrame) -> DataFrame:
    """Per shard: rows, bytes and the bounds of the curve and of each dimension."""
    dims = [c for c in sharded.columns if c[0] == "d" and c[1:].isdigit()]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"),
                                        *(f(c).alias(f"{f.__name__}_{c}") for c in ("cell", *dims) for f in (F.min, F.max)))
