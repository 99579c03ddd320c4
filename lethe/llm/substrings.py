"""Substring dedup: fixed-block anchors, extended to maximal exact repeats.

A window is ``window`` consecutive words of one document.  Every window holds a whole
block of ``window // 2`` words that starts at a multiple of that length in its document.

1. Each document's non-overlapping blocks are indexed by hash; every rolling window of
   block length, of every document, probes the index (packed look-up, see ``shards``).
   A hash counts as a hit if an indexed block with it exists and two documents hold it.
2. Hits are extended: each ``window`` that holds a hit is looked up by an 88-bit hash of
   its word sequence, which gives the smallest id whose document has the same sequence.
   Consecutive windows so found join into maximal repeated spans.

The first step only leaves out windows that no other document can have; the second is
exact (up to 88-bit hashes).  Cost is linear in words, also for a passage that a third of
all documents share: a shard sends each distinct hash once.

Defined results: null text is empty; a row without words keeps nothing and loses nothing;
rows with the same id do not repeat each other; a null id counts as larger than any
other; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shards as S
from .words import NULL_ID, chunks, roll, split

RESULT = "id long, n_words long, spans array<struct<first:int,last:int>>, kept_text string"
_SECOND = 0xA24BAED4963EE407 | 1      # base of the second hash
_KEY2 = 3                             # bytes of the second hash that are compared
_KEY1 = 6                             # bytes of a block hash that are compared within a bucket


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a shard and the word range of each document."""
    hashes, bounds, at = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, part in chunks(texts, texts):
        w = split(part)
        hashes.append(w.hashes)
        bounds.append(w.bounds[1:] + at)
        at += len(w.hashes)
    return np.concatenate(hashes), np.concatenate(bounds)


def _inside(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """Positions from which k words lie in one document."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return np.flatnonzero(left >= k)


def _blocks(hashes, bounds, window, block):
    """Positions, hashes and "is an indexed block" of the block-length windows of documents
    that have a whole window."""
    pos = _inside(bounds, len(hashes), block)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)[pos]
    ok = size[doc] >= window
    pos, doc = pos[ok], doc[ok]
    return pos, roll(hashes, block)[pos] if len(pos) else np.empty(0, np.uint64), (pos - bounds[doc]) % block == 0, doc


def _spread(pos, hashes, refs, docs):
    """Distinct hashes (sorted), whether one is an indexed block, whether two documents of the shard have it."""
    order = np.argsort(hashes)
    h = hashes[order]
    first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0) if len(h) else np.empty(0, np.int64)
    if not len(h):
        return h, np.empty(0, bool), np.empty(0, bool)
    d = docs[order]
    return h[first], np.logical_or.reduceat(refs[order], first), np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)


def _send_blocks(window, block, buckets):
    def run(key, table):
        _, texts = S.shard_of(table)
        h, refs, _ = _spread(*_blocks(*_words(texts), window, block))

        def body(lo, hi):
            return np.int32(hi - lo).tobytes() + S.low_bytes(h[lo:hi], _KEY1) + np.packbits(refs[lo:hi]).tobytes()
        return S.to_buckets(key[0].as_py(), h, buckets, body)
    return run


def _find_hits(key, table):
    """Hashes that two shards have and that one of them indexes, to each shard that has them."""
    shard, payload = table.column("shard").to_numpy(), table.column("payload").to_pylist()
    sizes = np.array([int(np.frombuffer(p, np.int32, 1)[0]) for p in payload])
    h = np.concatenate([S.from_low_bytes(p, _KEY1, n, 4) for p, n in zip(payload, sizes)])
    refs = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8, offset=4 + _KEY1 * n), count=n) for p, n in zip(payload, sizes)])
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    good = (size > 1) & (np.maximum.reduceat(refs[order], first) > 0)
    mine = np.sort(order[np.repeat(good, size)])
    which = np.searchsorted(np.cumsum(sizes), mine, side="right")
    cut = np.searchsorted(which, np.arange(len(payload) + 1))
    used = np.flatnonzero(np.diff(cut))
    return S.answers(shard[used].astype(np.int32), [S.low_bytes(h[mine[cut[k]:cut[k + 1]]], _KEY1) for k in used.tolist()])


def _candidates(hashes, bounds, window, block, hits: np.ndarray):
    """Starts of windows that hold a hit, and their document."""
    pos, h, refs, doc = _blocks(hashes, bounds, window, block)
    if not len(pos):
        return pos, doc
    u, ref, shared = _spread(pos, h, refs, doc)
    low = np.uint64((1 << 8 * _KEY1) - 1)
    hit = np.isin(u & low, hits) | (ref & shared)
    flag = np.zeros(len(hashes) + 1, dtype=np.int64)
    flag[pos + 1] = hit[np.searchsorted(u, h)]
    count = np.cumsum(flag)
    start = _inside(bounds, len(hashes), window)
    start = start[count[start + window - block + 1] > count[start]]
    return start, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[start]


def _keys(hashes, start, window):
    """Two hashes of the windows; the second has _KEY2 bytes."""
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return roll(hashes, window)[start], roll(hashes, window, _SECOND)[start] & np.uint64((1 << 8 * _KEY2) - 1)


def _groups(a, b):
    """Order by both keys, first place of each group, group of each item in that order."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.empty(0, bool)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _read_low(table: pa.Table) -> np.ndarray:
    raw = b"".join(table.column("payload").to_pylist())
    return S.from_low_bytes(raw, _KEY1, len(raw) // _KEY1)


def _send_windows(window, block, buckets):
    def run(key, left, right):
        ids, texts = S.shard_of(left)
        hashes, bounds = _words(texts)
        start, doc = _candidates(hashes, bounds, window, block, _read_low(right))
        a, b = _keys(hashes, start, window)
        order, first, _ = _groups(a, b)
        low = np.minimum.reduceat(ids[doc][order], first) if len(first) else np.empty(0, np.int64)
        a, b = a[order][first], b[order][first]

        def body(lo, hi):
            names, index = np.unique(low[lo:hi], return_inverse=True)
            wide = np.uint16 if len(names) < 1 << 16 else np.uint32
            return b"".join([np.array([hi - lo, len(names)], np.int32).tobytes(), names.tobytes(), a[lo:hi].tobytes(),
                             S.low_bytes(b[lo:hi], _KEY2), index.astype(wide).tobytes()])
        shard = next(iter(k for k in (left.column("shard") if left.num_rows else right.column("shard")).to_pylist()))
        return S.to_buckets(shard, a, buckets, body)
    return run


def _smallest(key, table):
    """To each shard, the windows that a document with a smaller id has elsewhere, with that id."""
    shard, payload = table.column("shard").to_numpy(), table.column("payload").to_pylist()
    a, b, low, which = [], [], [], []
    for k, p in enumerate(payload):
        n, m = np.frombuffer(p, np.int32, 2).tolist()
        names = np.frombuffer(p, np.int64, m, 8)
        a.append(np.frombuffer(p, np.uint64, n, 8 + 8 * m))
        b.append(S.from_low_bytes(p, _KEY2, n, 8 + 8 * m + 8 * n))
        wide = np.uint16 if m < 1 << 16 else np.uint32
        low.append(names[np.frombuffer(p, wide, n, 8 + 8 * m + (8 + _KEY2) * n)])
        which.append(np.full(n, k))
    a, b, low, which = map(np.concatenate, (a, b, low, which))
    order, first, group = _groups(a, b)
    least = np.empty(len(a), np.int64)
    least[order] = np.minimum.reduceat(low[order], first)[group]
    mine = np.flatnonzero(least < low)
    cut = np.searchsorted(which[mine], np.arange(len(payload) + 1))
    used = np.flatnonzero(np.diff(cut))
    out = []
    for k in used.tolist():
        i = mine[cut[k]:cut[k + 1]]
        out.append(np.int32(len(i)).tobytes() + a[i].tobytes() + S.low_bytes(b[i], _KEY2) + least[i].tobytes())
    return S.answers(shard[used].astype(np.int32), out)


def _cut(window):
    def run(key, left, right):
        ids, texts = S.shard_of(left)
        hashes, bounds = _words(texts)
        start = _inside(bounds, len(hashes), window)
        doc = np.repeat(np.arange(len(ids)), np.diff(bounds))[start]
        a, b = _keys(hashes, start, window)
        own = len(a)
        extra = [[], [], []]
        for p in right.column("payload").to_pylist():
            n = int(np.frombuffer(p, np.int32, 1)[0])
            extra[0].append(np.frombuffer(p, np.uint64, n, 4))
            extra[1].append(S.from_low_bytes(p, _KEY2, n, 4 + 8 * n))
            extra[2].append(np.frombuffer(p, np.int64, n, 4 + (8 + _KEY2) * n))
        a, b, low = (np.concatenate([x, *y]) for x, y in zip((a, b, ids[doc]), extra))
        order, first, group = _groups(a, b)
        gone = np.zeros(len(hashes) + 1, np.int64)
        if own:
            least = np.empty(len(a), np.int64)
            least[order] = np.minimum.reduceat(low[order], first)[group]
            bad = start[least[:own] < ids[doc]]
            np.add.at(gone, bad, 1)
            np.add.at(gone, bad + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for d, t in enumerate(texts):
            c = covered[bounds[d]:bounds[d + 1]]
            words = t.split()
            if c.any():
                edge = np.flatnonzero(np.diff(c.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                spans.append([{"first": i, "last": j - 1} for i, j in edge.reshape(-1, 2).tolist()])
                words = itertools.compress(words, (~c).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(bounds), pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    shard_bytes: int = S.SHARD_BYTES) -> DataFrame:
    """One row per document: id, n_words, removed ``spans`` (word numbers, both ends
    included) and ``kept_text`` (kept words joined by one space).

    A word goes if a window over it also starts in a document with a smaller id.
    """
    block = max(1, window // 2)
    n = S.plan_shards(docs, text_col, shard_bytes)
    buckets = n // 2
    packed = S.packed_docs(docs, id_col, text_col, n)
    hits = (packed.groupBy("shard").applyInArrow(_send_blocks(window, block, buckets), S.PACKED)
            .groupBy("bucket").applyInArrow(_find_hits, S.ANSWER))
    least = (packed.groupBy("shard").cogroup(hits.groupBy("shard"))
             .applyInArrow(_send_windows(window, block, buckets), S.PACKED)
             .groupBy("bucket").applyInArrow(_smallest, S.ANSWER))
    out = packed.groupBy("shard").cogroup(least.groupBy("shard")).applyInArrow(_cut(window), RESULT)
    return out.withColumn("id", F.expr(f"nullif(id, {NULL_ID}L)"))
