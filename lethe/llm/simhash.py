"""SimHash near-dedup by a binary trie self-join.

1. Fingerprints: each text's 3-word shingles, repeats included, vote on 64 bits.
2. Distinct fingerprints are range-partitioned in bit order, so each range is a run of
   leaves of one binary trie.  From the range bounds the driver walks the upper trie:
   node pairs go down together, differing bits add up, and a pair beyond the error budget
   is pruned; what is left are the pairs of ranges that can hold a link.
3. Each pair of ranges is one task's lower trie: again node pairs go down together, now
   over the fingerprints.  Open pairs wait on a stack in blocks, so memory is bounded.
   A task reports a spanning forest of its links (one edge a fingerprint at most), and
   connected components join the forests.

Copies of one fingerprint are one leaf, however many documents have it; distinct
fingerprints cannot crowd a range, whatever their prefix.  Ranges hold
max(``leaf``, distinct / ``MAX_RANGES``) fingerprints, so at most MAX_RANGES bounds reach
the driver.

Defined results: null text, empty text and text of separators only have the fingerprint
zero, linked like any other; with fewer than ``k`` words the whole sequence is the one
shingle; rows with a null or repeated id stay rows of their own, and a group's name is
its smallest id that is not null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .graph import components

LEAF = 1 << 15                 # fingerprints a range holds at least
MAX_RANGES = 1 << 14
_SEED = 42
_SLICE = 1 << 20               # bytes of a text that are split at a time
_BLOCK = 1 << 17               # node pairs that go down together
_SMALL = 8                     # node pairs of this many leaf pairs are compared directly
_SIGN = np.uint64(1 << 63)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


# Fingerprints -----------------------------------------------------------------------------
def _word_runs(text: bytes):
    """The words of a text, a slice at a time."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + _SLICE)
        end = m.start() if m else len(text)
        yield text[at:end].split()
        at = end


def _votes(shingles) -> tuple[int, np.ndarray]:
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=_SEED), shingles), dtype="<u8")
    return len(h), np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, k: int = 3) -> int:
    """A bit is set if it is set in over half of the XXH64 hashes of the shingles."""
    carry, n, ones = [], 0, np.zeros(64, np.int64)
    for words in _word_runs(text.lower()):
        words = carry + words
        if len(words) >= k:
            m, part = _votes(map(b" ".join, zip(*(words[i:] for i in range(k)))))
            n, ones = n + m, ones + part
        carry = words[max(0, len(words) - k + 1):]
    if not n and carry:
        n, ones = _votes([b" ".join(carry)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a long."""
    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, k) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# Trie walks ---------------------------------------------------------------------------------
def range_pairs(low: np.ndarray, high: np.ndarray, budget: int) -> np.ndarray:
    """Pairs (i, j), i <= j, of ranges [low[i], high[i]] (disjoint, ascending uint64) that can hold
    two values differing in ``budget`` bits or fewer.  A node is a prefix with the run of
    ranges it touches."""
    out = [np.empty((0, 2), np.int64)]
    a = b = np.zeros(1, np.uint64)
    err = np.zeros(1, np.int64)
    for depth in range(65):
        rest = np.uint64((1 << (64 - depth)) - 1)
        touch = [(np.searchsorted(high, p), np.searchsorted(low, p | rest, side="right")) for p in (a, b)]
        (a0, a1), (b0, b1) = touch
        live = (a0 < a1) & (b0 < b1)
        done = live & (a1 - a0 == 1) & (b1 - b0 == 1)
        out.append(np.column_stack([a0[done], b0[done]]))
        open_ = live & ~done
        if depth == 64 or not open_.any():
            break
        a, b, err = a[open_], b[open_], err[open_]
        bit = np.uint64(1 << (63 - depth))
        same, room = a == b, err < budget
        parts = [(a, b, err), (a | bit, b | bit, err), (a[room], b[room] | bit, err[room] + 1),
                 (a[room & ~same] | bit, b[room & ~same], err[room & ~same] + 1)]
        a, b, err = (np.concatenate(c) for c in zip(*parts))
    pairs = np.concatenate(out)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def trie_links(x: np.ndarray, y: np.ndarray | None, budget: int):
    """Blocks (i, j) of links between the sorted distinct uint64 arrays x and y (x with itself,
    i < j, if y is None): all pairs that differ in ``budget`` bits or fewer."""
    own = y is None
    y = x if own else y
    if not len(x) or not len(y):
        return
    counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ones(depth):
        if depth not in counts:
            bit = np.uint64(63 - depth)
            c = [np.concatenate([[0], np.cumsum((v >> bit & np.uint64(1)).astype(np.int32))]).astype(np.int32) for v in ((x,) if own else (x, y))]
            counts[depth] = c[0], c[-1]
        return counts[depth]
    one = np.zeros(1, np.int64)
    stack = [(0, one, one + len(x), one, one + len(y), one)]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > _BLOCK:
            for at in range(0, len(a0), _BLOCK):
                stack.append((depth, *(v[at:at + _BLOCK] for v in (a0, a1, b0, b1, err))))
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= _SMALL) | (depth == 64)
        if small.any():
            m = size[small]
            pair = np.repeat(np.flatnonzero(small), m)
            k = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            wide = (b1 - b0)[pair]
            i, j = a0[pair] + k // wide, b0[pair] + k % wide
            near = np.bitwise_count(x[i] ^ y[j]) <= budget
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        a0, a1, b0, b1, err = (v[~small] for v in (a0, a1, b0, b1, err))
        cx, cy = ones(depth)
        am, bm = a1 - (cx[a1] - cx[a0]), b1 - (cy[b1] - cy[b0])
        room = err < budget
        cross = room & ~((a0 == b0) & (a1 == b1)) if own else room
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err),
                 tuple(v[room] for v in (a0, am, bm, b1, err + 1)), tuple(v[cross] for v in (am, a1, b0, bm, err + 1))]
        a0, a1, b0, b1, err = (np.concatenate(c) for c in zip(*parts))
        live = (a0 < a1) & (b0 < b1)
        if live.any():
            stack.append((depth + 1, *(v[live] for v in (a0, a1, b0, b1, err))))


def _root(name: np.ndarray, i: np.ndarray) -> np.ndarray:
    at = name[i]
    while True:
        up = name[at]
        if (up == at).all():
            name[i] = at
            return at
        at = up


def unite(name: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the ends of the links; name[v] <= v is the parent of v, a root is its own."""
    while len(i):
        i, j = _root(name, i), _root(name, j)
        differ = i != j
        i, j = i[differ], j[differ]
        np.minimum.at(name, np.maximum(i, j), np.minimum(i, j))


# The join -----------------------------------------------------------------------------------
def _packed(batches):
    """The fingerprints of one range as one row: ascending, the sign bit turned so that the
    order of longs is the order of the trie."""
    held = [(b.column("range"), b.column("fp").to_numpy()) for b in batches if b.num_rows]
    if held:
        fp = np.sort(np.concatenate([f for _, f in held]))
        yield pa.RecordBatch.from_pydict({"range": held[0][0].slice(0, 1), "low": pa.array(fp[:1]), "high": pa.array(fp[-1:]),
                                          "leaves": pa.array([(fp.view(np.uint64) ^ _SIGN).tobytes()], pa.binary())})


def _forest(budget: int):
    """Spanning forest (a, b) of the links in one pair of ranges."""
    def run(key, table):
        sides = dict(zip(table.column("side").to_pylist(), table.column("leaves").to_pylist()))
        x, *other = (np.frombuffer(sides[s], np.uint64) for s in sorted(sides))
        every = np.concatenate([x, *other])
        name = np.arange(len(every))
        for i, j in trie_links(x, other[0] if other else None, budget):
            unite(name, i, j + len(x) if other else j)
        child = np.flatnonzero(name != np.arange(len(every)))
        return pa.table({c: pa.array((every[v] ^ _SIGN).view(np.int64)) for c, v in (("a", child), ("b", name[child]))})
    return run


def near_links(distinct: DataFrame, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` just as the links do."""
    spark = distinct.sparkSession
    distinct = cut_lineage(distinct.select("fp"))
    n = distinct.count()
    ranges = max(1, -(-n // max(leaf, n // MAX_RANGES + 1)))
    dealt = distinct.repartitionByRange(ranges, "fp").withColumn("range", F.spark_partition_id())
    packed = cut_lineage(dealt.mapInArrow(_packed, "range int, low long, high long, leaves binary"))
    bounds = sorted((r.low, r.high, r.range) for r in packed.select("low", "high", "range").collect())
    low, high, number = (np.array(c, dtype=np.int64) for c in (zip(*bounds) if bounds else ((), (), ())))
    pairs = range_pairs(low.view(np.uint64) ^ _SIGN, high.view(np.uint64) ^ _SIGN, budget)
    pair = np.arange(len(pairs))
    two = pairs[:, 0] != pairs[:, 1]
    routes = pa.table({"range": pa.array(number[np.concatenate([pairs[:, 0], pairs[two, 1]])].astype(np.int32)),
                       "pair": pa.array(np.concatenate([pair, pair[two]])),
                       "side": pa.array(np.repeat(np.array([0, 1], np.int32), [len(pairs), int(two.sum())]))})
    routed = packed.select("range", "leaves").join(spark.createDataFrame(routes), "range").select("pair", "side", "leaves")
    return routed.groupBy("pair").applyInArrow(_forest(budget), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id, fp, component_id (smallest id reachable by links)."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, k))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    comp = components(near_links(classes, budget, leaf))
    named = classes.join(comp.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "component").select("fp", "component_id"), "fp").select("id", "fp", "component_id")
