"""Benchmark decontamination with SimHash of item-sized windows.

Words are runs of ASCII letters, digits and non-ASCII characters other than typographic
marks, A-Z folded, so changes of case and punctuation do not matter.  An item of L words is compared with every window of L
words of every document, on bags of ``k``-word shingles:

1. A window can only reach the similarity if enough of its shingles occur in the benchmark
   at all (an exact bound, from a sliding count); other windows are left out unhashed.
2. Windows get two 64-bit SimHash fingerprints.  Items of the same length are found through
   a multi-index: 8 blocks of 8 bits, each probed for all values within 2 bits, which by the
   pigeonhole rule yields every item within ``RADIUS`` = 16 bits (8 * (2 + 1) > 16).  At so
   wide a radius a block passes 37 of 256 values, so over half of the items of a length
   stay candidates; windows and items are compared in steps of bounded size.
3. The bag Jaccard similarity (shingles weighted by their counts) of window and item is
   computed in whole; ``percent`` or more is a hit.

At the threshold itself two bags of equal size differ in 9.7 of 64 bits on average (standard
deviation 2.9), so one fingerprint finds 98.7 % and the two together 99.98 % of such pairs;
closer pairs, exact copies above all, are found without fail.

A document with fewer words than the item is one window, the whole document.  Its bag is the
smaller one, so an item of m shingles needs at least ceil(percent * m / 100) of them there.  These
windows are few (one a document and item length) and small bags of unequal size lie further
apart, so they are compared with every item by a count of shared shingles, not by
fingerprint; ``hamming`` is the distance all the same and may pass ``RADIUS``.

The benchmark is a stated query set: it is taken in blocks of at most ``BLOCK_ITEMS`` items,
each compared with all documents.

Defined results: null text is empty; an item without words matches nothing; an item with
fewer than ``k`` words is one shingle and must stand whole; equal items report separately;
rows with the same id report separately; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import NULL_ID, chunks, mix, roll, split

RADIUS = 16
BLOCK_ITEMS = 50_000
HITS = "id long, item_id long, first_word long, n_words long, hamming int, similarity double"

_CELLS = 1 << 20               # window and item pairs that are compared at a time
_SEEDS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D))
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_NEAR = np.array([[(a ^ b).bit_count() <= 2 for b in range(256)] for a in range(256)])


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """(rows, 2) SimHash fingerprints of a (rows, m) matrix of shingle hashes."""
    out = np.empty((len(shingles), 2), np.uint64)
    for j, seed in enumerate(_SEEDS):
        for lo in range(0, len(shingles), 512):
            part = mix(shingles[lo:lo + 512] ^ seed)
            bits = np.unpackbits(part[..., None].view(np.uint8), axis=-1, bitorder="little")
            out[lo:lo + 512, j] = ((2 * bits.sum(axis=1, dtype=np.int32) > part.shape[1]) * _BITS).sum(axis=1, dtype=np.uint64)
    return out


class LengthIndex:
    """Items of one length: fingerprints in a multi-index, and their bags of shingles."""

    def __init__(self, ids: list[int], shingles: np.ndarray):
        self.ids, self.bags = ids, np.sort(shingles, axis=1)
        self.prints = fingerprints(shingles)
        self.blocks = self.prints.view(np.uint8).reshape(len(ids), 2, 8)

    def holding(self, bag: np.ndarray, need: int) -> list[int]:
        """Items of which at least ``need`` shingles occur in the sorted bag."""
        at = np.minimum(np.searchsorted(bag, self.bags), len(bag) - 1)
        return np.flatnonzero((bag[at] == self.bags).sum(axis=1) >= need).tolist()

    def candidates(self, prints: np.ndarray):
        """(window, item, distance) for all pairs within RADIUS in either fingerprint, in steps of
        at most about ``_CELLS`` pairs: two values within RADIUS have a block within 2 bits."""
        step = max(1, _CELLS // len(self.ids))
        found = [self._near(prints[lo:lo + step], lo) for lo in range(0, len(prints), step)]
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def _near(self, prints, lo):
        blocks = prints.view(np.uint8).reshape(len(prints), 2, 8)
        best = np.full((len(prints), len(self.ids)), 65, np.uint8)
        for f in range(2):
            some = np.zeros(best.shape, bool)
            for b in range(8):
                some |= _NEAR[blocks[:, f, b, None], self.blocks[None, :, f, b]]
            w, i = np.nonzero(some)
            best[w, i] = np.minimum(best[w, i], np.bitwise_count(prints[w, f] ^ self.prints[i, f]))
        w, i = np.nonzero(best <= RADIUS)
        return w + lo, i, best[w, i].astype(np.int64)


def bag_overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted bags."""
    values, count = np.unique(a, return_counts=True)
    lo, hi = np.searchsorted(b, values), np.searchsorted(b, values, side="right")
    return int(np.minimum(count, hi - lo).sum())


class Benchmark:
    """The query set: items by length, and all their shingles by shingle size."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, percent: int):
        self.k, self.percent = k, percent
        by_length: dict[int, tuple[list, list]] = {}
        for i, text in items:
            w = split([text], lower=True, alnum=True)
            n = len(w.hashes)
            if n:
                ids, rows = by_length.setdefault(n, ([], []))
                ids.append(i)
                rows.append(roll(w.hashes, min(k, n)))
        self.lengths = {n: LengthIndex(ids, np.array(rows)) for n, (ids, rows) in sorted(by_length.items())}
        self.known = {}
        for n, x in self.lengths.items():
            self.known.setdefault(min(k, n), []).append(x.bags.ravel())
        self.known = {s: np.unique(np.concatenate(v)) for s, v in self.known.items()}

    def hits(self, texts: list[bytes]):
        """(document, item id, first word, words, distance, similarity), best window of each pair."""
        w = split(texts, lower=True, alnum=True)
        n_words = len(w.hashes)
        best: dict[tuple[int, int], tuple] = {}
        for size, known in self.known.items():
            codes = roll(w.hashes, size)
            if not len(codes):
                continue
            seen = np.zeros(1 << 20, bool)
            seen[(known >> np.uint64(44)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(codes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, codes[maybe]), len(known) - 1)
            place = maybe[known[at] == codes[maybe]]
            doc = np.searchsorted(w.bounds, place, side="right") - 1
            ok = place + size <= w.bounds[doc + 1]
            place, doc = place[ok], doc[ok]
            for d in np.unique(doc).tolist():
                self._document(best, d, size, codes, place[doc == d] if len(doc) < 1000 else place[slice(*np.searchsorted(doc, [d, d + 1]))],
                               int(w.bounds[d]), int(w.bounds[d + 1]))
        return [(d, item, *v[2:]) for (d, item), v in best.items()]

    def _document(self, best, d, size, codes, place, lo, hi):
        """Windows of one document; ``place`` has its shingles that the benchmark knows."""
        for n, index in self.lengths.items():
            if min(self.k, n) != size:
                continue
            m = n - size + 1
            if hi - lo < n:
                self._whole(best, d, index, codes[lo:hi - size + 1], len(place), hi - lo, m)
                continue
            need = -(-2 * self.percent * m // (100 + self.percent))
            if len(place) < need:
                continue
            # window [s, s + m) has `need` known shingles: place j and place j + need - 1 lie in it
            first = place[:len(place) - need + 1]
            low = np.maximum(place[need - 1:] - m + 1, lo)
            high = np.minimum(first, hi - n)
            some = np.flatnonzero(low <= high)
            if not len(some):
                continue
            start = np.unique(np.concatenate([np.arange(low[j], high[j] + 1) for j in some.tolist()]))
            for cut in range(0, len(start), 4096):
                part = start[cut:cut + 4096]
                bags = codes[part[:, None] + np.arange(m)]
                for win, item, distance in zip(*(x.tolist() for x in index.candidates(fingerprints(bags)))):
                    both = bag_overlap(np.sort(bags[win]), index.bags[item])
                    if 100 * both >= self.percent * (2 * m - both):
                        s = int(part[win])
                        key = (-both / (2 * m - both), s, s - lo, n, distance, both / (2 * m - both))
                        k = (d, index.ids[item])
                        if k not in best or key < best[k]:
                            best[k] = key


    def _whole(self, best, d, index, codes, n_known, n_words, m):
        """A document with fewer words than the items of ``index``: itself the one window."""
        both_sizes = len(codes) + m
        need = -(-self.percent * both_sizes // (100 + self.percent))
        if min(n_known, len(codes)) < need:
            return
        bag, prints = np.sort(codes), None
        for item in index.holding(bag, need):
            both = bag_overlap(bag, index.bags[item])
            if 100 * both >= self.percent * (both_sizes - both):
                prints = fingerprints(codes[None]) if prints is None else prints
                distance = int(np.bitwise_count(prints[0] ^ index.prints[item]).min())
                similarity = both / (both_sizes - both)
                key = (-similarity, 0, 0, n_words, distance, similarity)
                k = (d, index.ids[item])
                if k not in best or key < best[k]:
                    best[k] = key


def _scan(bench: Benchmark):
    def run(batches):
        for b in batches:
            out = []
            for ids, texts in chunks(b.column("id").to_pylist(), b.column("text").to_pylist()):
                out += [(ids[d], *rest) for d, *rest in bench.hits(texts)]
            cols = list(zip(*out)) or [[]] * 6
            types = (pa.int64(),) * 4 + (pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["id", "item_id", "first_word", "n_words", "hamming", "similarity"])
    return run


def _clean_rows(bench: Benchmark, text_col: str):
    """Batches without the documents that hold an item, all columns kept."""
    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for rows, texts in chunks(range(b.num_rows), [(t or "").encode() for t in b.column(text_col).to_pylist()]):
                for d, *_ in bench.hits(texts):
                    keep[rows[d]] = False
            yield b.filter(pa.array(keep))
    return run


def _benchmarks(items: DataFrame, item_id_col: str, item_text_col: str, k: int, percent: int):
    """The items in blocks of at most about BLOCK_ITEMS."""
    items = items.select(F.coalesce(F.col(item_id_col).cast("long"), F.lit(NULL_ID)).alias("i"),
                         F.coalesce(F.col(item_text_col), F.lit("")).cast("binary").alias("t"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for b in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield Benchmark([(r.i, bytes(r.t)) for r in held], k, percent)


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                   item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document and item that it holds: id, item_id, and the best window's
    first_word, n_words, hamming and similarity."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    out = None
    for bench in _benchmarks(items, item_id_col, item_text_col, k, percent):
        hits = rows.mapInArrow(_scan(bench), HITS)
        out = hits if out is None else out.union(hits)
    return out.withColumns({c: F.expr(f"nullif({c}, {NULL_ID}L)") for c in ("id", "item_id")})


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for bench in _benchmarks(items, item_id_col, item_text_col, k, percent):
        docs = docs.mapInArrow(_clean_rows(bench, text_col), docs.schema)
    return docs
