"""Portable seeded randomness.

Every random choice in the library is a pure function of (key, seed), so a choice
is the same in Spark, in DuckDB and after a task is re-run on another executor.
The draw is the first 32 bits of md5("<key>:<seed>") as an unsigned integer.
DuckDB spelling of the same value::

    cast(('0x' || substr(md5(cast(key as varchar) || ':' || seed), 1, 8)) as bigint)
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def phash(key, seed) -> Column:
    """Unsigned 32-bit draw in [0, 2^32) as BIGINT."""
    text = F.concat(_c(key).cast("string"), F.lit(":"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(key, seed) -> Column:
    """Uniform double in [0, 1)."""
    return phash(key, seed) / F.lit(TWO_32)


def gaussian(key, seed) -> Column:
    """Standard normal draw of (key, seed): Box-Muller over two draws of the key."""
    radius = F.sqrt(F.lit(-2.0) * F.log((phash(key, f"{seed}:r") + 1) / F.lit(TWO_32)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(key, f"{seed}:a"))


def gaussian_vector(d: int, seed, sigma: float = 1.0) -> list[float]:
    """sigma times the draws of the keys 0..d-1, as the driver's parameters need them."""
    def draw(key, part):
        return int(hashlib.md5(f"{key}:{seed}:{part}".encode()).hexdigest()[:8], 16)
    return [sigma * math.sqrt(-2.0 * math.log((draw(j, "r") + 1) / TWO_32)) * math.cos(2.0 * math.pi * draw(j, "a") / TWO_32) for j in range(d)]


# MD5's steps: what is added, the rotation, the message word read.
_ADD = [int(abs(math.sin(i + 1)) * TWO_32) for i in range(64)]
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORD = [(a * i + b) % 16 for r, (a, b) in enumerate(((1, 0), (5, 1), (3, 5), (7, 0))) for i in range(16 * r, 16 * r + 16)]
_INIT = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_DRAW_STEP = 1 << 15           # draws made at once, to stay near a core's cache
_BLOCK = 55                    # bytes of a message of one block


def _first_words(words: list[np.ndarray], size: int) -> np.ndarray:
    """The first 32 bits of the md5 of one-block messages of ``size`` bytes: ``words`` are their leading
    words, up to the byte 0x80 after the message."""
    a, b, c, d = (np.full(len(words[0]), v, np.uint32) for v in _INIT)
    f = np.empty_like(a)
    for i in range(61):        # the steps after it change the other words
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        w = _WORD[i]
        if w < len(words):
            np.add(a, words[w], out=a)
        np.add(a, np.uint32((_ADD[i] + (8 * size if w == 14 else 0)) & 0xFFFFFFFF), out=a)
        np.right_shift(a, np.uint32(32 - _TURN[i]), out=f)
        np.left_shift(a, np.uint32(_TURN[i]), out=a)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_INIT[0])).byteswap()


def position_draws(prefixes: Sequence[bytes], first: Sequence[int], counts: Sequence[int], seed) -> np.ndarray:
    """``phash`` of every prefix followed by each of its ``counts`` positions from ``first`` on, one after another.

    Messages of the same layout (bytes of the prefix, digits of the position) are hashed together."""
    out, tail, at = np.empty(int(np.sum(counts)), np.uint32), f":{seed}".encode(), 0
    layouts = defaultdict(list)
    for prefix, p, n in zip(prefixes, np.asarray(first).tolist(), np.asarray(counts).tolist()):
        end = p + n
        while p < end:
            digits = len(str(p))
            stop = min(end, 10 ** digits)
            layouts[len(prefix), digits].append((prefix, p, stop - p, at))
            at, p = at + stop - p, stop
    for (before, digits), runs in layouts.items():
        size = before + digits + len(tail)
        if size > _BLOCK:
            for prefix, p, n, to in runs:
                out[to:to + n] = [int.from_bytes(hashlib.md5(prefix + str(q).encode() + tail).digest()[:4], "big") for q in range(p, p + n)]
            continue
        begin, n = np.array([r[1] for r in runs]), np.array([r[2] for r in runs])
        ends = np.cumsum(n)
        frames = b"".join((r[0] + bytes(digits) + tail + b"\x80").ljust(size // 4 * 4 + 4, b"\0") for r in runs)
        frames = np.frombuffer(frames, "<u4").reshape(len(runs), -1)
        offset = begin - (ends - n)
        drawn = np.empty(ends[-1], np.uint32)
        for lo in range(0, ends[-1], _DRAW_STEP):
            hi = min(lo + _DRAW_STEP, ends[-1])
            i, j = np.searchsorted(ends, (lo, hi - 1), "right")
            here = np.minimum(ends[i:j + 1], hi) - np.maximum((ends - n)[i:j + 1], lo)
            words = [np.repeat(frames[i:j + 1, w], here) for w in range(frames.shape[1])]
            left = (np.arange(lo, hi) + np.repeat(offset[i:j + 1], here)).astype(np.uint64 if digits > 9 else np.uint32)
            for place in range(before + digits - 1, before - 1, -1):
                rest = left // 10
                words[place // 4] |= ((left - rest * 10).astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (place % 4))
                left = rest
            drawn[lo:hi] = _first_words(words, size)
        for r, end in zip(runs, ends.tolist()):
            out[r[3]:r[3] + r[2]] = drawn[end - r[2]:end]
    return out
