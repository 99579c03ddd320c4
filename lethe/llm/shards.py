"""Documents dealt into shards, and look-ups of word-window hashes across shards.

A shard is a group of documents (by hash of the id) that one task can hold.  Instead of
one row per window, a shard sends to every hash bucket one packed row with its *distinct*
hashes, and the bucket answers the shard with the hashes that matter.  Each hash occurs
once per shard at most, so a window shared by a third of all documents costs a bucket no
more entries than there are shards: the pre-aggregation before the shuffle.

Packed rows number shards x buckets: raise ``shard_bytes`` with the input (16 MB suits
executors with 1.5 GB a core; 256 MB and more is right for 100 TB).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import NULL_ID

SHARD_BYTES = 16 << 20
PACKED = "bucket int, shard int, payload binary"
ANSWER = "shard int, payload binary"


def plan_shards(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> int:
    """Number of shards: two for each ``shard_bytes`` of text, or for each shuffle partition
    if those are more, so that hashing deals them out evenly.  Callers use half as many
    buckets, so packed rows number twice the square of the partitions at most."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 2 * max(parts, math.ceil(size / shard_bytes))


def pack(ids: np.ndarray, texts: list[bytes]) -> bytes:
    """Documents as one compressed blob."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = b"".join([np.int64(len(texts)).tobytes(), np.asarray(ids, dtype=np.int64).tobytes(), sizes.tobytes(), *texts])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, dtype=np.int64, count=1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    ids = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
    ends = 8 + 16 * n + np.cumsum(np.frombuffer(raw, dtype=np.int64, count=n, offset=8 + 8 * n))
    begin, out = 8 + 16 * n, []
    for end in ends.tolist():
        out.append(raw[begin:end])
        begin = end
    return ids, out


def packed_docs(docs: DataFrame, id_col: str, text_col: str, shards: int, limit: int = 8 << 20) -> DataFrame:
    """(shard, payload): the documents, null text as empty, null id as NULL_ID, packed per
    input task and shard, so that the shuffle moves compressed blobs."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def flush():
            keys = sorted(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([pack(np.array(held[k][0]), held[k][1]) for k in keys], pa.binary())],
                names=["shard", "payload"])
        for b in batches:
            for i, t, s in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("shard").to_pylist()):
                ids, texts = held.setdefault(s, ([], []))
                ids.append(i)
                texts.append(t)
                size += len(t) + 100
                if size > limit * 4:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()
    return rows.mapInArrow(run, ANSWER)


def shard_of(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Documents of one shard, in order of id."""
    ids, texts = [], []
    for blob in table.column("payload").to_pylist():
        i, t = unpack(blob)
        ids.append(i)
        texts += t
    ids = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], [texts[k] for k in order.tolist()]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top 24 bits, so sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def low_bytes(x: np.ndarray, n: int) -> bytes:
    """The n lowest bytes of each uint64."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(raw: bytes, n: int, count: int, offset: int = 0) -> np.ndarray:
    out = np.zeros((count, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(raw, dtype=np.uint8, count=count * n, offset=offset).reshape(count, n)
    return out.reshape(-1).view("<u8")


def to_buckets(shard: int, hashes: np.ndarray, buckets: int, body) -> pa.Table:
    """Packed rows of one shard: ``hashes`` is sorted; ``body(lo, hi)`` gives a slice's bytes."""
    cut = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut))
    return pa.table({"bucket": pa.array(used.astype(np.int32)), "shard": pa.array(np.full(len(used), shard, dtype=np.int32)),
                     "payload": pa.array([body(int(cut[b]), int(cut[b + 1])) for b in used.tolist()], pa.binary())})


def answers(shards: np.ndarray, payloads: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int32()), "payload": pa.array(payloads, pa.binary())})
