"""Vectorised word splitting and word-window hashing for Arrow batches.

Texts are handled as UTF-8 bytes.  A chunk of documents is concatenated into one
buffer; word bounds and hashes come from whole-buffer NumPy passes, so the cost per
word is a few array operations and never a Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NULL_ID = (1 << 63) - 1            # stands for a null id inside tasks; sorts last

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[list(_SPACES)] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
# Typographic marks: second bytes of U+00A0..00BF that are no letters or digits, after 0xC2,
# and the lead bytes of U+2000..206F (general punctuation).
_LATIN_MARK = np.zeros(256, dtype=bool)
_LATIN_MARK[0xA0:0xC0] = True
_LATIN_MARK[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = False


def _letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to words of letters and digits; ``buf`` ends with a separator."""
    flag = _ALNUM[buf]
    at = np.flatnonzero(buf == 0xC2)
    at = at[_LATIN_MARK[buf[at + 1]]]
    flag[at] = flag[at + 1] = False
    at = np.flatnonzero(buf == 0xE2)
    at = at[at + 2 < len(buf)]
    at = at[(buf[at + 1] == 0x80) | ((buf[at + 1] == 0x81) & (buf[at + 2] < 0xB0))]
    flag[at] = flag[at + 1] = flag[at + 2] = False
    return flag

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown and kept per process)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up = np.full(m, base, dtype=np.uint64)
        down = np.full(m, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if m <= 1 << 23:
            _powers[base] = have
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Words of a chunk of documents: byte bounds, hash, and word range of each document."""
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray             # document d has the words bounds[d]:bounds[d + 1]

    def windows(self, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 words of the chunk have none."""
        return roll(self.hashes, k, base)

    def last_start(self, k: int) -> np.ndarray:
        """Per word, true where k words from here on lie in the same document."""
        n = len(self.hashes)
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(n)
        return left >= k


def roll(codes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Polynomial hash of every run of k codes, mixed; empty if there are fewer codes."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(n + 1, base)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * up[:n], out=total[1:])
    return mix((total[k:] - total[:n - k + 1]) * down[:n - k + 1])


def split(texts: list[bytes], lower: bool = False, alnum: bool = False) -> Words:
    """Words of the texts: runs of non-space bytes, or (``alnum``) of ASCII letters, digits and
    non-ASCII bytes less the typographic marks of U+00A0..00BF and U+2000..206F; ``lower``
    folds A-Z before hashing."""
    sep = b" "
    buf = np.frombuffer(sep.join(texts) + sep, dtype=np.uint8)
    flag = (_letters(buf) if alnum else _NOT_SPACE[buf]).view(np.int8)
    edges = np.flatnonzero(np.diff(flag, prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    code = _BYTE_CODE[_LOWER[buf]] if lower else _BYTE_CODE[buf]
    up, down = powers(len(buf) + 1, _MULT)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(code * up[:len(buf)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return Words(buf, starts, ends, hashes, np.searchsorted(starts, offsets))


def chunks(ids, texts: list[bytes], limit: int = 1 << 20):
    """Consecutive documents in runs of at most about ``limit`` bytes (one document at least)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield ids[first:i], texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield ids[first:], texts[first:]
