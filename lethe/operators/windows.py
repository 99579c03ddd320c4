"""Stride-1 windows cut to the smallest seeded hashes while they are held as texts.

A window's draw depends on its text's key and its position alone, so a task makes the draws of
all windows of a text in arrays, and only the windows that are kept become rows.  Texts are
packed STEP windows at a time and kept in the checkpoint folder with what the draws say: a
bit a window for those surely below the boundary, and the draws of the few near it (a pack's
share of the boundary strays from the expected one by the root of its windows).  So every draw
is made once; where the boundary lies outside what a pack foresaw, its draws are made again.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import TWO_32, position_draws
from ..session import cut_lineage
from .sampling import boundary, settled

STEP = 1 << 20                 # windows of a pack
OUT_ROWS = 1 << 17             # rows of an Arrow batch
BUCKETS = 1 << 16              # of the draws' high bits
SIGMAS = 8                     # half the width of what a pack keeps, in standard deviations
NEAR = np.dtype([("at", "<i4"), ("draw", "<u4"), ("times", "<i4")])


def _foreseen(n: int, share: float) -> tuple[int, int]:
    """(first, last) bucket in which the boundary is looked for by a pack of ``n`` windows."""
    p = min(max(share, 0.0), 1.0)
    half = SIGMAS * math.sqrt(p * (1 - p) / max(n, 1)) + 2 * SIGMAS / max(n, 1)
    return max(math.floor((p - half) * BUCKETS), 0), min(math.floor((p + half) * BUCKETS), BUCKETS - 1)


class _Pack:
    """Texts of a pack: windows are numbered through its texts, ``times`` has how many rows of the
    change set each one meets."""

    def __init__(self, rows: pa.RecordBatch, length: int):
        self.rows, self.k = rows, length
        self.first = rows.column("first").to_numpy()
        self.n = rows.column("n").to_numpy()
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.times = np.zeros(self.start[-1], np.int32)
        sizes = rows.column("times").value_lengths().to_numpy()
        values, ends = rows.column("times").flatten().to_numpy(), np.cumsum(sizes)
        lo = rows.column("lo").to_numpy()
        for i in np.flatnonzero(sizes).tolist():
            at = self.start[i] + lo[i]
            self.times[at:at + sizes[i]] = values[ends[i] - sizes[i]:ends[i]]

    def draws(self, seed) -> np.ndarray:
        # a null key is left out of what is hashed
        prefixes = [b"" if s is None else s.encode() + b":" for s in self.rows.column("name").to_pylist()]
        return position_draws(prefixes, self.first, self.n, seed)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def positions(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        return self.first[text] + at - self.start[text]

    def names(self, at: np.ndarray) -> list[str]:
        """What is hashed for the windows, without the seed."""
        text = self.text_of(at)
        some = self.rows.column("name").take(pa.array(text, pa.int64())).to_pylist()
        return [f"{p}" if s is None else f"{s}:{p}" for s, p in zip(some, self.positions(at, text).tolist())]

    def written(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(self.rows)
        return sink.getvalue().to_pybytes()

    @classmethod
    def read(cls, body: pa.Scalar, length: int) -> _Pack:
        with pa.ipc.open_stream(body.as_buffer()) as rows:
            return cls(rows.read_next_batch(), length)

    def built(self, at: np.ndarray, key: str):
        """Rows (key, pos, ctx, next, is_changed) of the windows ``at``, in their order, as often as they meet
        the change set."""
        codes = np.frombuffer("".join(self.rows.column("text").to_pylist()).encode("utf-32-le"), "<u4")
        size, byte = np.ones(len(codes), np.uint8), np.zeros(len(codes) + 1, np.int32)
        for more in (0x7F, 0x7FF, 0xFFFF):
            size += codes > more
        np.cumsum(size, out=byte[1:])

        def strings(begin, k):
            """The k characters from ``begin`` on, side by side in UTF-8."""
            ends = np.zeros(len(begin) + 1, np.int32)
            np.cumsum(byte[begin + k] - byte[begin], out=ends[1:])
            chars = np.ndarray(len(codes) - k + 1, f"V{4 * k}", codes, strides=(4,))[begin] if k else b""
            return pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(str(chars, "utf-32-le").encode()))
        if len(self.times) and self.times.max() > 1:
            at = np.repeat(at, np.maximum(self.times[at], 1))
        for i in range(0, len(at), OUT_ROWS):
            some = at[i:i + OUT_ROWS]
            text = np.repeat(np.arange(len(self.n)), np.diff(np.searchsorted(some, self.start)))
            begin = some + self.k * text                     # a text has k characters more than windows
            yield pa.RecordBatch.from_arrays(
                [self.rows.column("key").take(pa.array(text)), pa.array(self.positions(some, text).astype(np.int32)),
                 strings(begin, self.k), strings(begin + self.k, 1), pa.array(self.times[some] > 0)], names=[key, "pos", "ctx", "next", "is_changed"])


def _texts(batches, length: int, step: int):
    """Packs of the batches' texts (key, name, text, lo, times); a long text comes in pieces that
    overlap by ``length`` characters."""
    def pack(b, held):
        row, first, n, text, lo, times = zip(*held)
        row = pa.array(row, pa.int64())
        sizes = np.cumsum([0, *map(len, times)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(times).astype(np.int32)))
        return _Pack(pa.RecordBatch.from_arrays([b.column("key").take(row), b.column("name").take(row), pa.array(first, pa.int64()), pa.array(n, pa.int64()),
                                                 pa.array(text, pa.string()), pa.array(lo, pa.int64()), lists], names=["key", "name", "first", "n", "text", "lo", "times"]), length)
    none = np.empty(0, np.int32)
    for b in batches:
        held, size = [], 0
        for row in range(b.num_rows):
            text = b.column("text")[row].as_py()
            windows = len(text or "") - length
            if windows <= 0:
                continue
            marks = b.column("times")[row]
            marks, lo = (marks.values.to_numpy(), b.column("lo")[row].as_py()) if marks.is_valid else (none, 0)
            for at in range(0, windows, step):
                n = min(step, windows - at)
                begin, end = max(lo - at, 0), min(lo + len(marks) - at, n)
                held.append((row, at, n, text[at:at + n + length], begin, marks[at + begin - lo:at + end - lo] if begin < end else none))
                size += n
                if size >= step:
                    yield pack(b, held)
                    held, size = [], 0
        if held:
            yield pack(b, held)


def cut_windows(texts: DataFrame, length: int, seed, share: float, quota, key: str, step: int = STEP) -> DataFrame:
    """The windows (key, pos, ctx, next, is_changed) of the texts with the smallest (draw, "key:pos") of
    the changed ones and of the others, as ``sampling.hash_cut`` cuts rows.  ``texts`` has key, name
    (the key as a string), text, and lo, times: how many rows of the change set the windows from
    position lo on meet.  ``quota`` makes group -> int from the groups' rows, of which it is expected
    to take ``share``.
    """
    kind = texts.schema["key"].dataType.simpleString()

    def pack(batches):
        for p in _texts(batches, length, step):
            draw, info, near = p.draws(seed), [], []
            changed, bucket = np.flatnonzero(p.times), draw >> 16
            sure = np.zeros(len(draw), bool)
            for which, n in ((None, len(draw) - len(changed)), (changed, len(changed))):
                first, last = _foreseen(n, share)
                mine = bucket if which is None else bucket[which]
                below, at = mine < first, (mine >= first) & (mine <= last)
                if which is None:
                    below[changed] = at[changed] = False
                    sure |= below
                    at = np.flatnonzero(at)
                    rows, low = n, int(np.count_nonzero(below))
                else:
                    sure[which[below]] = True
                    at = which[at]
                    rows, low = int(p.times[which].sum(dtype=np.int64)), int(p.times[which[below]].sum(dtype=np.int64))
                near.append(np.empty(len(at), NEAR))
                near[-1]["at"], near[-1]["draw"], near[-1]["times"] = at, draw[at], p.times[at]
                info.append([rows, low, first, last])
            n, low, first, last = zip(*info)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.written()], pa.binary()), pa.array([np.packbits(sure).tobytes()], pa.binary()), pa.array([np.concatenate(near).tobytes()], pa.binary()),
                 *(pa.array([x], pa.list_(pa.int64())) for x in (n, low, first, last))], names=["pack", "sure", "near", "n", "below", "first", "last"])
    packs = cut_lineage(texts.select("key", "name", "text", "lo", "times").mapInArrow(
        pack, "pack binary, sure binary, near binary, n array<bigint>, below array<bigint>, first array<bigint>, last array<bigint>"))
    groups = (False, True)
    told = packs.agg(*[f(F.get(c, F.lit(int(g)))).alias(f"{c}_{g}") for g in groups for c, f in (("n", F.sum), ("below", F.sum), ("first", F.max), ("last", F.min))]).first()
    have = {g: told[f"n_{g}"] for g in groups if told[f"n_{g}"]}
    need = quota(have)

    def counted(pairs):
        """Rows (g, b, n) of (changed, bucket, times)."""
        out = {(g, b): n for g in groups for b, n in enumerate(np.bincount(np.concatenate([[0], *(x[1][x[0] == g] for x in pairs)]).astype(np.int64),
                                                                         np.concatenate([[0], *(x[2][x[0] == g] for x in pairs)])).tolist()) if n}
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.bool_()), pa.array([b for _, b in out], pa.int64()), pa.array([int(n) for n in out.values()], pa.int64())], names=["g", "b", "n"])

    def near_counts(batches):
        for b in batches:
            near = [np.frombuffer(x.as_buffer(), NEAR) for x in b.column("near")]
            yield from counted([(x["times"] > 0, x["draw"] >> 16, np.maximum(x["times"], 1)) for x in near])

    def all_counts(batches):
        for b in batches:
            for body in b.column("pack"):
                p = _Pack.read(body, length)
                yield from counted([(p.times > 0, p.draws(seed) >> 16, np.maximum(p.times, 1))])

    def buckets(column, make):
        found = defaultdict(list)
        for r in packs.select(column).mapInArrow(make, "g boolean, b bigint, n bigint").groupBy("g", "b").agg(F.sum("n").alias("n")).collect():
            found[r["g"]].append((r["b"], r["n"]))
        return found
    whole, pending = [g for g in have if need.get(g, 0) >= have[g]], {}
    asked = [g for g in have if 0 < need.get(g, 0) < have[g]]
    if asked:
        near = buckets("near", near_counts)
        missed = []
        for g in asked:
            low = [(-1, told[f"below_{g}"])] if told[f"below_{g}"] else []
            b = boundary(low + near[g], need[g])
            if b is None or not told[f"first_{g}"] <= b[0] <= told[f"last_{g}"]:
                missed.append(g)
            else:
                pending[g] = b
        if missed:
            every = buckets("pack", all_counts)
            pending |= {g: boundary(every[g], need[g]) for g in missed}

    def seen(b, row, p):
        """(windows surely below the pending groups' boundary buckets, those of the buckets, their draws)."""
        first, last = (b.column(c)[row].as_py() for c in ("first", "last"))
        if all(first[g] <= at <= last[g] for g, (at, _) in pending.items()):
            near = np.frombuffer(b.column("near")[row].as_buffer(), NEAR)
            sure = np.unpackbits(np.frombuffer(b.column("sure")[row].as_buffer(), np.uint8), count=len(p.times)).astype(bool)
            at, draw = near["at"], near["draw"]
            for g in groups:
                if g not in pending:
                    sure &= p.times == 0 if g else p.times > 0
        else:
            draw = p.draws(seed)
            at, sure = np.arange(len(draw)), np.zeros(len(draw), bool)
        changed, bucket = p.times[at] > 0, draw >> 16
        edge = np.zeros(len(at), bool)
        for g, (bound, _) in pending.items():
            edge |= (changed == g) & (bucket == bound)
            sure[at[(changed == g) & (bucket < bound)]] = True
        return sure, at[edge], draw[edge]

    def edges(batches):
        for b in batches:
            for row in range(b.num_rows):
                p = _Pack.read(b.column("pack")[row], length)
                _, at, draw = seen(b, row, p)
                times = np.maximum(p.times[at], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p.times[at] > 0, times)), pa.array(np.repeat(draw, times).astype(np.int64)),
                                                  pa.array(p.names(np.repeat(at, times)), pa.string())], names=["g", "_h", "k"])
    ties = settled(packs.mapInArrow(edges, "g boolean, _h bigint, k string"), pending) if pending else {}

    def kept(batches):
        for b in batches:
            for row in range(b.num_rows):
                p = _Pack.read(b.column("pack")[row], length)
                keep, at, draw = seen(b, row, p)
                for g, (h, last) in ties.items():
                    mine = (p.times[at] > 0) == g
                    keep[at[mine & (draw < h)]] = True
                    tied = at[mine & (draw == h)]
                    keep[tied[np.array([k <= last for k in p.names(tied)], bool)]] = True
                for g in whole:
                    keep |= p.times > 0 if g else p.times == 0
                yield from p.built(np.flatnonzero(keep), key)
    return packs.mapInArrow(kept, f"`{key}` {kind}, pos int, ctx string, next string, is_changed boolean")
