"""Best-fit packing planned on the length histogram.

1. Tokenise: ids of each text plus the end id; documents longer than ``capacity`` are cut
   into pieces of ``capacity``.
2. The histogram of piece lengths (``capacity`` counts at most) is all the planner sees.
   Best-fit decreasing runs over counts: all pieces of one length go into the fullest bins
   that still hold them, whole runs of bins at a time, then into new bins.  The plan is a
   list of runs: pieces ranked [lo, hi) of a length take bins first, first + 1, ... at one
   offset.  Its size depends on the number of lengths, not on the number of documents.
3. Pieces take slots by rank within their length.  Ranks come from counts by
   (length, slice of the id hash), so no length, however common, meets in one task.

Defined results: null text is empty; a null id is kept as it is; every piece has at least
the end id; rows with the same id are separate documents; an empty table gives an empty
result; columns besides id and text are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .words import NULL_ID

_CACHE_WORDS = 250_000         # chunks, and pieces of chunks, remembered per Python worker
_RANK_SLICES = 64


class WordTokens(dict):
    """Bytes of a white-space-free chunk of text -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those
    of its chunks.  Chunks of ASCII and Latin-1 letters are lower-cased and cut here and
    only their pieces go through the BPE model; any other chunk takes the whole tokenizer.
    """
    _plain = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
    _cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in printable)
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > _CACHE_WORDS:
            self.clear()
        if len(self.pieces) > _CACHE_WORDS:
            self.pieces.clear()
        text = chunk.decode("utf-8", "replace")
        if len(chunk) <= 200 and "<|" not in text and self._plain.fullmatch(text):
            ids = b"".join([self.pieces.get(p) or self.piece(p) for p in self._cut.findall(text.lower())])
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(chunk) <= 200:
            self[chunk] = ids
        return ids

    def piece(self, p: str) -> bytes:
        spelled = p if p.isascii() else "".join(map(self.alphabet.__getitem__, p.encode()))
        ids = self.pieces[p] = np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()
        return ids


_tokens: dict[str, WordTokens] = {}


def token_bytes(text: bytes, path: str) -> bytes:
    """Ids of a text as little-endian uint32 bytes (no special tokens added)."""
    have = _tokens.get(path)
    if have is None:
        _tokens.clear()
        have = _tokens[path] = WordTokens(path)
    return b"".join(map(have.__getitem__, text.split()))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each document."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = token_bytes(t, tokenizer) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(cols)],
                                             names=["id", "piece", "start", "length", "ids_crc32"])
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram.

    Returns runs (length, lo, hi, first bin, offset): pieces ranked lo <= r < hi of that
    length go to bin ``first + r - lo`` at ``offset``.  ``space[r]`` lists runs of open bins
    (first, end) that have r free places.
    """
    space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins, plan = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        free = length
        while left:
            while free <= capacity and not space[free]:
                free += 1
            if free > capacity:                 # no bin holds it: open as many as these pieces fill
                need = -(-left // (capacity // length))
                space[capacity].append((bins, bins + need))
                bins, free = bins + need, capacity
            first, end = space[free].pop()
            take = min(left, end - first)
            if take < end - first:
                space[free].append((first + take, end))
            plan.append((length, rank, rank + take, first, capacity - free))
            rank, left = rank + take, left - take
            if free - length:
                space[free - length].append((first, first + take))
                if free - length >= length:
                    free = free - length
    return plan


def _ranked(pieces: DataFrame) -> DataFrame:
    """Pieces with their rank within their length: rank in a slice, plus the slices before."""
    cut = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "piece"), F.lit(_RANK_SLICES)).cast("int"))
    before = (cut.groupBy("length", "slice").agg(F.count("*").alias("c"))
              .withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))))
    place = F.row_number().over(Window.partitionBy("length", "slice").orderBy("id", "piece", "ids_crc32", "start"))
    return (cut.withColumn("place", place)
            .join(before.select("length", "slice", F.coalesce("before", F.lit(0)).alias("before")), ["length", "slice"])
            .withColumn("rank", F.col("place") - 1 + F.col("before")))


def best_fit_pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                  end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_lineage(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id))
    counts = dict(map(tuple, pieces.groupBy("length").count().collect()))       # capacity rows at most
    plan = np.array(best_fit_plan(counts, capacity), dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    span = int(max(counts.values(), default=0)) + 1
    keys = plan[:, 0] * span + plan[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = plan[np.searchsorted(keys, length * span + rank, side="right") - 1] if len(length) else plan[:0]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                                             names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    out = _ranked(pieces).select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("id", F.expr(f"nullif(id, {NULL_ID}L)"))
