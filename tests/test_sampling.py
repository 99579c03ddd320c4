"""Exact hash sampling, distributed ranks and shards against brute force."""
import hashlib

from pyspark.sql import functions as F

from lethe.operators import prefix, sampling as sa


def _h(k, seed):
    return int(hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:8], 16)


def test_hash_cut_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    got = sorted(r.row_id for r in sa.choose_rows(df, "row_id", 137, 9).collect())
    want = sorted(sorted(range(5000), key=lambda k: (_h(k, 9), k))[:137])
    assert got == want
    per = sa.hash_cut(df, "row_id", 9, {0: 5, 1: 0, 2: 3000}, by="g").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in per} == {0: 5, 2: 1666}


def test_global_rank(spark):
    df = spark.range(3000).select(F.col("id"), ((F.col("id") * 7919) % 3001).alias("k"))
    r = prefix.global_rank(df, [F.col("k"), F.col("id")], n_parts=7).collect()
    want = {i: n + 1 for n, i in enumerate(sorted(range(3000), key=lambda i: ((i * 7919) % 3001, i)))}
    assert all(x["rank"] == want[x.id] for x in r)


def test_shard_union_is_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"))
    s = sa.assign_shards(df, "row_id", 7, 3)
    assert s.select("row_id").distinct().count() == 1000
    assert s.agg(F.min("shard"), F.max("shard")).collect()[0] == (0, 6)


def test_hash_cut_keeps_the_null_group(spark):
    from lethe.operators.sampling import hash_cut
    df = spark.createDataFrame([(k, None if k % 3 else "g") for k in range(30)], "id long, g string")
    assert sorted(r["count"] for r in hash_cut(df, "id", 1, 4, by="g").groupBy("g").count().collect()) == [4, 4]
    assert hash_cut(df, "id", 1, 100, by="g").count() == 30
